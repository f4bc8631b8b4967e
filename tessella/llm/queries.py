"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import fertility, fingerprint, kdshard, licenses, mixing, packing, simhash, suffixdedup, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_kd_sharding": kdshard.op2_kd_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_improbable_features": fingerprint.op4_improbable_features,
    "op5_warc": warc.op5_warc,
    "op6_fertility": fertility.op6_fertility,
    "op7_mixing": mixing.op7_mixing,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_packing": packing.op9_packing,
    "op10_suffix_dedup": suffixdedup.op10_suffix_dedup,
    "base_counts_of_texts": fertility.base_counts_of_texts,
    "edited_texts": fingerprint.edited_texts,
}
ORACLES = {
    "op5_warc": warc.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op8_license_scan": licenses.ORACLE_SQL,
    "op10_suffix_dedup": suffixdedup.ORACLE_SQL,
    "base_counts_of_texts": fertility.BASE_SQL,
    "edited_texts": fingerprint.EDITED_SQL,
}
