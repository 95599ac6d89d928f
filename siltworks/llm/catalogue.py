"""The subpackage's queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import embeddings, licences, minhash, mixing, oracles, packing, quality, secrets, sharding, substrings, urls

QUERIES = {
    "op1_rotation_codes": embeddings.query,
    "op2_licence_lines": licences.query,
    "op3_seed_and_extend": substrings.query,
    "op4_shard_best_fit": sharding.query,
    "op5_pack_best_fit": packing.query,
    "op6_url_graph": urls.query,
    "op7_mix_curriculum": mixing.query,
    "op8_minmax_near_dedup": minhash.query,
    "op9_forest_secrets": secrets.query,
    "op10_risk_controlled": quality.query,
}

ORACLES = {
    "op1_rotation_codes": oracles.OP1,
    "op3_seed_and_extend": oracles.OP3,
    "op6_url_graph": oracles.OP6,
    "op7_mix_curriculum": oracles.OP7,
    "op8_minmax_near_dedup": oracles.OP8,
    "op10_risk_controlled": oracles.OP10,
}
