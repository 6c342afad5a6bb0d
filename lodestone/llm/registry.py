"""Queries of this subpackage and the SQL they are held against, by name."""

from __future__ import annotations

from . import ann, decontam, licenses, packing, quality, secrets, simhash, substrings, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1,
    "op2_secret_scan": secrets.op2,
    "op3_quality_rules": quality.op3,
    "op4_substring_dedup": substrings.op4,
    "op5_toxicity": toxicity.op5,
    "op6_warc_index": warc.op6,
    "op7_permutation_ann": ann.op7,
    "op8_decontamination": decontam.op8,
    "op9_license_scan": licenses.op9,
    "op10_best_fit_packing": packing.op10,
}

ORACLES = {
    "op4_substring_dedup": substrings.ORACLE,
    "op6_warc_index": warc.ORACLE,
    "op8_decontamination": decontam.ORACLE,
    "op9_license_scan": licenses.ORACLE,
}
