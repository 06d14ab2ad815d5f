"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from strandframe.llm import bpe, decontaminate, jaccard, licences, pii, ppm, quality, suffixes, vantage, warc
from strandframe.session import few_files, small_batches


def _few(query):
    """The query over texts in batches of bounded bytes; its result as few files when it is written."""

    def run(spark, sf_dir: str):
        small_batches(spark)
        return few_files(query(spark, sf_dir))

    return run


QUERIES = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_vp_tree_neighbours": vantage.op2_vp_tree_neighbours,
    "op3_license_scan": licences.op3_license_scan,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_warc_round_trip": warc.op5_warc_round_trip,
    "op6_ppm_scores": ppm.op6_ppm_scores,
    "op7_pii_spans": pii.op7_pii_spans,
    "op8_knn_quality": quality.op8_knn_quality,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
}
QUERIES = {name: _few(query) for name, query in QUERIES.items()}
ORACLE: dict[str, str] = {
    "op2_vp_tree_neighbours": vantage.ORACLE_SQL,
    "op3_license_scan": licences.ORACLE_SQL,
    "op5_warc_round_trip": warc.ORACLE_SQL,
    "op9_jaccard_join": jaccard.ORACLE_SQL,
    "op10_suffix_dedup": suffixes.ORACLE_SQL,
}
