"""The queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import html, jaccard, maxent, media, middle, mixing, names, passages, rulelist, secrets, toxicity, warc, winnow
from .common import tune

_QUERIES = [
    passages.op1_substring_dedup,
    warc.op2_warc,
    maxent.op3_lm_scoring,
    mixing.op4_mixing_sources,
    html.op5_html_extraction,
    winnow.op6_decontamination,
    media.op7_media_columns,
    secrets.op8_secret_scans,
    jaccard.op9_ngram_jaccard_join,
    toxicity.op10_toxicity,
    middle.op11_fill_in_middle,
    rulelist.op12_quality_rules,
    names.op13_edit_distance_name_join,
]
_ORACLES = {
    "op2_warc": warc.ORACLE,
    "op4_mixing_sources": mixing.ORACLE,
    "op5_html_extraction": html.ORACLE,
    "op6_decontamination": winnow.ORACLE,
    "op9_ngram_jaccard_join": jaccard.ORACLE,
    "op11_fill_in_middle": middle.ORACLE,
}


def _tuned(f):
    def run(spark, sf_dir):
        tune(spark)
        return f(spark, sf_dir)

    return run


def queries():
    return {f.__name__: _tuned(f) for f in _QUERIES}


def oracle_sql():
    return dict(_ORACLES)
