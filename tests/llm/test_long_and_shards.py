"""Very long chat texts, tables as chats, and documents dealt to shards."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from contactweave.llm import chat, mixing


def test_texts_past_the_limit_of_parsed_records_are_kept(spark):
    """A text of 30 MB in a table of turns; tried by hand with 132 MB, which takes a heap
    of over 4 GB, as rows are copied several times."""
    rows = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 0, F.repeat(F.lit("ask # "), 1)).otherwise(F.repeat(F.lit("long <text> "), 2_500_000)).alias("text"))
    out = chat.format_turns(chat.column_turns(rows)).select("conv_id", "n_turns", F.length("formatted").alias("n"), F.element_at("loss", 1).alias("loss"))
    (r,) = out.collect()
    size = 2_500_000 * (len("long <text> ") + 1)
    assert (r.conv_id, r.n_turns, r.loss["end"] - r.loss["start"]) == (1, 2, size)
    assert r.n == len("### user: ask \\h </turn>\n") + len("### assistant: ") + size + len("</turn>\n")


def test_a_large_record_that_is_not_parsed_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat, "LARGE", 50)
    rows = spark.createDataFrame([('{"prompt": "' + "x" * 100,)], "record string")
    with pytest.raises(Exception, match="bytes can't be parsed"):
        chat.canonical_turns(rows).collect()
    rows = spark.createDataFrame([('{"prompt": "' + "x" * 10,), ('{"prompt": "' + "x" * 100 + '", "completion": "y"}',)], "record string")
    assert sorted(r.layout or "" for r in chat.canonical_turns(rows).collect()) == ["", "prompt", "prompt"]


TABLES = [
    ("conv_id long, turn int, role string, text string, extra string", (4, 2, "user", "a", "x"), [(4, "turn rows", 2, "user", "a")]),
    ("id int, messages array<struct<role:string,content:string,name:string>>", (5, [("user", "a", "n"), ("assistant", None, "n")]), [(5, "messages", 0, "user", "a"), (5, "messages", 1, "assistant", None)]),
    ("id long, conversations array<struct<from:string,value:string>>", (6, [("human", "q")]), [(6, "from-value list", 0, "human", "q")]),
    ("prompt string, completion string", ("p", "c"), [(None, "prompt", 0, "user", "p"), (None, "prompt", 1, "assistant", "c")]),
    ("id long, instruction string, input string, output string", (7, "do", "this", "done"), [(7, "instruction", 0, "user", "do\nthis"), (7, "instruction", 1, "assistant", "done")]),
    ("id long, instruction string, output string", (8, "do", "done"), [(8, "instruction", 0, "user", "do"), (8, "instruction", 1, "assistant", "done")]),
    ("id long, question string, answer string", (9, "q", "a"), [(9, "question", 0, "user", "q"), (9, "question", 1, "assistant", "a")]),
    ("id long, messages array<struct<role:string,content:string>>", (9, []), [(9, "messages", None, None, None)]),
]


@pytest.mark.parametrize("schema,row,want", TABLES)
def test_tables_give_the_turns_that_their_records_give(spark, schema, row, want):
    df = spark.createDataFrame([row], schema)
    of = lambda out: sorted(((r.conv_id, r.layout, r.turn, r.role, r.text) for r in out.collect()), key=str)
    assert of(chat.column_turns(df)) == want
    records = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    assert of(chat.canonical_turns(records)) == want


def test_a_table_without_a_layout_is_an_error(spark):
    with pytest.raises(ValueError, match="a, b"):
        chat.column_turns(spark.createDataFrame([(1, 2)], "a int, b int"))


def once_of(tagged):
    """Shards of the rows whose text stands once in the mix."""
    found = {}
    for r in tagged.collect():
        found.setdefault((r.doc_id, r.text), []).append(r.shard)
    return {k: v[0] for k, v in found.items() if len(v) == 1}


def mixed(docs, seed=1):
    mix = dataclasses.replace(mixing.Mix(), seed=seed, block=16, slots_per_shard=40)
    return mixing.sharded_documents(docs, mix), mixing.mixed_documents(docs, mix)


def test_documents_come_by_shard_and_the_draw_decides_it(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(7 + i % 40)), "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tagged, out = mixed(docs)
    shards = once_of(tagged)
    assert len(set(shards.values())) > 1
    for part in out.rdd.glom().collect():
        got = [shards[r.doc_id, r.text] for r in part if (r.doc_id, r.text) in shards]
        assert got == sorted(got)
    # Another draw deals the same words otherwise.
    other, _ = mixed(docs, 2)
    again = once_of(other)
    both = shards.keys() & again.keys()
    assert len(both) > 30 and any(shards[k] != again[k] for k in both)
    words = lambda keys: sum(len(t.split()) for _, t in keys)
    total = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit("[^ ]+")))).first()[0]
    assert abs(total(tagged) - words(rows_of(rows))) <= 1 and total(tagged) == total(other) == total(out)
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r)[:3] for r in tagged.collect())


def rows_of(rows):
    return [(i, t) for i, t, _ in rows]


def test_columns_named_shard_stay(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30, "a", 7)], "doc_id long, text string, source string, shard long")
    _, out = mixed(docs)
    assert out.columns == docs.columns and {r.shard for r in out.collect()} == {7}
