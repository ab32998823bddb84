import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

from linework.llm.collocations import OP12_SQL, SLOTS, Chunk, collocations, op12_collocations

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top, longest=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in wanted.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in wanted.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def run(spark, rows, schema="doc_id long, text string, lang string", **options):
    found = collocations(spark.createDataFrame(rows, schema), **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("slots", [1 << 27, 1 << 15])
def test_against_brute_force(spark, slots):
    """With few slots as with many."""
    import random

    rng = random.Random(5)
    words = ["a", "b", "B", "é", "É", "x|y", "\x00", "ab", "a b"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ".", "\n", "\x0b", " - "]) for _ in range(rng.randrange(120)))
    rows = [(i % 3, text(), rng.choice(["en", "de", None, ""])) for i in range(60)] + [(None, None, "en"), (1, "", "fr"), (1, " . ", "fr")]
    rows += [rows[0]] * 3
    got = run(spark, rows, least=4, top=50, slots=slots)
    assert got == brute([(r[2], r[1]) for r in rows], 4, 50) and len(got) > 100


def test_clashing_columns_long_texts_and_empty_tables(spark):
    long = "to be or not " * 50_000
    rows = [(1, long, "en", "w1", 2), (2, "one.two " * 40_000, "en", "lang", 3)]
    schema = "doc_id long, text string, lang string, w1 string, c int"
    assert run(spark, rows, schema) == brute([("en", long), ("en", "one.two " * 40_000)], 30, 2000)
    assert run(spark, [], schema) == []
    assert run(spark, [(1, "word " * 9, None, "", 0)], schema) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    found = op12_collocations(spark, SF)
    rel = con.sql(OP12_SQL)
    assert sorted(rel.columns) == sorted(found.columns)
    assert sorted(tuple(r) for r in found.select(*rel.columns).collect()) == sorted(rel.fetchall())


def test_a_chunk_holds_few_bytes_a_word():
    c = Chunk(["en"] * 10, ["a b c d, e f g h. " * 500] * 10, SLOTS)
    held = sum(x.nbytes for v in vars(c).values() for x in (v if isinstance(v, list) else [v]) if hasattr(x, "nbytes"))
    assert held <= 24 * len(c.word) and c.there[0].sum() == 40000
