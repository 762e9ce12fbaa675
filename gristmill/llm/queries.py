"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, chroma, langid, licenses, manifest, mixing, packing, pages, pii, quality, runs, simhash, suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_simhash": simhash.op2_simhash,
    "op3_chroma": chroma.op3_chroma,
    "op4_langid": langid.op4_langid,
    "op5_mixing": mixing.op5_mixing,
    "op6_suffixes": suffixes.op6_suffixes,
    "op7_pages": pages.op7_pages,
    "op8_packing": packing.op8_packing,
    "op9_pii": pii.op9_pii,
    "op10_licenses": licenses.op10_licenses,
    "op11_runs": runs.op11_runs,
    "op12_bestfit": bestfit.op12_bestfit,
    "op13_manifest": manifest.op13_manifest,
}

SQL: dict[str, str] = {
    "op1_quality": quality.OP1_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op8_packing": packing.OP8_SQL,
    "op10_licenses": licenses.OP10_SQL,
    "op11_runs": runs.OP11_SQL,
    "op13_manifest": manifest.OP13_SQL,
}
