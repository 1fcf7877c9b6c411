"""The registered queries over the smallest tables: against their SQL, or brute force where SQL has no form."""

import hashlib
import os

import duckdb
import pytest

from loamwork.llm import mixing, pii, sentence_pieces
from loamwork.llm.queries import QUERIES
from loamwork.llm.sql import ORACLE_SQL
from tests.llm.test_text_operators import plain_spans

DATA = os.environ.get("LOAMWORK_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages conversations labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    done = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in done.description]
    want = sorted(repr([r[columns.index(c)] for c in df.columns]) for r in done.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(list(r)) for r in df.collect()) == want


def test_personal_data_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op4_pii"](spark, DATA).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]


def test_toxic_labels_are_found(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op3_toxicity"](spark, DATA).collect()}
    told = [(labels[i], got[i].toxic) for i in labels if i in got]
    assert sum(bool(t) == p for t, p in told) / len(told) > 0.9 and all(r.kept != r.toxic for r in got.values())


def test_mix_follows_the_schedule(spark):
    got = QUERIES["op7_mixing_sources"](spark, DATA).collect()
    counts = {}
    for r in got:
        counts[f"s{r.source}"] = counts.get(f"s{r.source}", 0) + 1
    place = {}
    for p in mixing.schedule({k: -(-n // 64) for k, n in counts.items()}, mixing.target_weights(counts)):
        for b in range(p.first, p.last):
            place[p.source, b] = p.start_slot + (b - p.first) // len(p.slots) * p.period + p.slots[(b - p.first) % len(p.slots)]
    slots = {}
    for r in got:
        slots.setdefault((f"s{r.source}", r.mix_slot), set()).add(r.mix_offset)
    assert {(s, t) for s, t in slots} == {(s, t) for (s, _), t in place.items()}
    assert sum(map(len, slots.values())) == len(got)


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.MODEL)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op10_sentencepiece"](spark, DATA).collect()
    assert all(r.ids == library.encode(texts[r.doc_id]) and r.round_trip for r in got)
