import base64
import hashlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_jaccard import brute as near
from test_pii import by_brute_force, by_definition

from strandframe.llm import bpe, pii, quality, registry
from strandframe.llm.decontaminate import best_stretch
from strandframe.llm.words import WORD_TABLE, words
from strandframe.session import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"t-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] > 0.5 * counts[0]
    assert docs.where("n_chars != char_length(text)").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id", "decoded_sha256")
    assert last.join(docs.selectExpr("doc_id", "sha2(text, 256) as want"), "doc_id").where("want != decoded_sha256").count() == 0


def test_every_operator_has_its_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES)
    assert numbers == list(range(1, 11)) and set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("text", [None, "", "word " * 3])
def test_near_duplicates_of_odd_rows(spark, text):
    rows = spark.createDataFrame([(1, text, "en", "s", 0), (2, text, "en", "s", 0), (2, text, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicate_stage(spark, rows, SF)
    assert left.count() == (1 if text and text.strip() else 2)


def test_the_whole_run_against_brute_force(spark):
    """Each stage made again text by text: votes, all pairs, all stretches, patterns and counts, the tokenizer library."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {i: t for i, t in rows.items() if model.score(quality.features(t)[None])[0] >= 0.3}
    ids = list(rows)
    rows = {i: rows[i] for i, low, _ in near([rows[i] for i in ids], ids) if i == low}
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def contaminated(text):
        found = words(text)
        number = {w: n for n, w in enumerate(set(found))}
        place = np.array([number[w] for w in found], np.int64)
        return any(item and best_stretch(np.array([number.get(w, -1) for w in item]), place)[0] <= int(0.2 * len(item)) for item in items)

    rows = {i: t for i, t in rows.items() if not contaminated(t or "")}
    terms = by_brute_force(list(rows.values()))
    for i, t in rows.items():
        base = by_definition(t or "")
        more = [(m.start(), m.end(), 4) for m in pii.TOKEN.finditer(t or "") if m.group().encode().translate(WORD_TABLE) in terms and not any(a < m.end() and m.start() < b for a, b, _ in base)]
        rows[i] = pii.redacted(t, sorted([*base, *more], key=lambda s: (s[0], s[2]))) or ""
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).splitlines())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    want = {i: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows.items()}
    got = {r["doc_id"]: (list(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(want) > 80


def test_stages_of_empty_and_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0), (8, "x" * 100_000, None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, odd, SF)
        assert name in ("quality", "near_duplicates", "decontaminate") or out.count() == 7, name
        assert name == "bpe" or out.columns == docs.columns
