"""Record linkage on Spark: what a program needs of it under one name."""

from tessera.functions.text import (
    clean_address,
    clean_name,
    domain_stem,
    normalize_records,
    normalize_text,
    numeric_tokens,
    pin_premise_tokens,
    pin_tokens,
    premise_tokens,
    preprocess,
    strip_legal_forms,
)
from tessera.operators.decide import blend_loaded, decide
from tessera.operators.evaluate import grid, macro, match_band
from tessera.operators.features import V16, V18, domain_match, pair_features, script_mismatch
from tessera.operators.model import PRESETS, challenge, score, train, train_or_load
from tessera.operators.retrieval import candidates, hard_negatives, recall_report
from tessera.operators.validate import check
from tessera.plans.link import link, sample, train_on
from tessera.sources.archive import bundle
from tessera.sources.linkage import read_lists, read_records, run_in_buckets, write_lists, write_sample

__all__ = [
    "PRESETS", "V16", "V18", "blend_loaded", "bundle", "candidates", "challenge", "check", "clean_address", "clean_name", "decide", "domain_match", "domain_stem", "grid", "hard_negatives", "link", "macro", "match_band",
    "normalize_records", "normalize_text", "numeric_tokens", "pair_features", "pin_premise_tokens", "pin_tokens", "premise_tokens", "preprocess", "read_lists", "read_records", "recall_report", "run_in_buckets",
    "sample", "score", "script_mismatch", "strip_legal_forms", "train", "train_on", "train_or_load", "write_lists", "write_sample",
]
