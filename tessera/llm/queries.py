"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from . import bpe, decontaminate, filter_audit, html_extract, language_id, media, periodic_runs, secret_scan, sharding, simhash, substring_dedup, token_binary, warc_revisit
from .common import table


def _on(name, f):
    return lambda spark, sf_dir: f(spark, table(spark, sf_dir, name))


QUERIES = {
    "op4_warc_revisits": _on("pages", warc_revisit.op4),
    "op2_language_evidence": lambda spark, sf_dir: language_id.op2(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")),
    "op9_benchmark_decontamination": lambda spark, sf_dir: decontaminate.op9(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op6_super_kmer_dedup": _on("documents", substring_dedup.op6),
    "op5_simhash_pigeonring": _on("documents", simhash.op5),
    "op7_credential_linking": _on("documents", secret_scan.op7),
    "op1_html_extraction": _on("pages", html_extract.op1),
    "op3_token_binary": _on("documents", token_binary.op3),
    "op8_telephony_audio": _on("documents", media.op8),
    "op10_tree_bpe": _on("documents", bpe.op10),
    "op11_balanced_shards": _on("documents", sharding.op11),
    "op12_periodic_runs": _on("documents", periodic_runs.op12),
    "op13_filter_audit": lambda spark, sf_dir: filter_audit.op13(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}
ORACLES: dict[str, str] = {"op4_warc_revisits": warc_revisit.OP4_SQL, "op11_balanced_shards": sharding.OP11_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
