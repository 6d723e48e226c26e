"""Registered queries on sf0.001 against their SQL twins, and the pipeline against brute force."""

import array
import os
import sys
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from shelfcast.llm import registry  # noqa: E402
from shelfcast.llm.packing import cut  # noqa: E402
from shelfcast.llm.pii import find_spans, learn_field  # noqa: E402
from shelfcast.llm.toxicity import score_toxicity  # noqa: E402

from brute import brute_components, brute_spans, sequential_best_fit  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert [x for x in names if x.startswith(f"op{n}_")]
    assert "pipeline" in names and set(registry.ORACLE) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(c for c, *_ in con.execute(f"DESCRIBE ({registry.ORACLE[name]})").fetchall())
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE[name]})").fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.select(columns).collect()), key=key) == sorted(want, key=key)


def test_pipeline_equals_brute_force(spark):
    """Each stage against a version of its own on the input it was given; all columns stay until the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    at, results = docs, []
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF).cache()
        results.append(at)
    quality, clean, single, private, packed = results
    assert all(x.columns == docs.columns for x in results[:4])
    texts = [{r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (docs, *results[:4])]

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({registry.ORACLE['op2_quality_rules']})").fetchall() if k}
    assert texts[1] == {i: t for i, t in texts[0].items() if i in kept}

    scores = {r.doc_id: r.score for r in score_toxicity(quality, labels).collect()}
    assert texts[2] == {i: t for i, t in texts[1].items() if scores[i] < 0.3}

    least = {i: c for i, _, c, _ in brute_components(sorted(texts[2].items()), 80)}
    assert texts[3] == {i: t for i, t in texts[2].items() if least[i] == i}

    field = learn_field(single, 20_000)
    for i, text in texts[3].items():
        spans = find_spans(text, field, 0.9)[1]
        assert set(brute_spans(text)) <= set(spans)
        masked_text = text
        for kind, a, b in sorted(spans, key=lambda s: -s[1]):  # from the back; none overlap here
            masked_text = masked_text[:a] + f"[{kind.upper()}]" + masked_text[b:]
        assert texts[4][i] == masked_text
    assert {r.doc_id: r.n_chars for r in private.collect()} == {i: len(t) for i, t in texts[4].items()}

    tokenizer = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, text in texts[4].items():
        ids = array.array("I", tokenizer.encode(text, add_special_tokens=False).ids + [2])
        want += [(i, n, a, k, zlib.crc32(ids[a:a + k].tobytes())) for n, (a, k) in enumerate(cut(len(ids), 1024))]
    key = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    got = packed.collect()
    assert key(got) == sorted(want)
    assert len({r.sequence_id for r in got}) == sequential_best_fit([w[3] for w in want], 1024)
    assert key(registry.QUERIES["pipeline"](spark, SF).collect()) == sorted(want)
