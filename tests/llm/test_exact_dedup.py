from linework.llm.exact_dedup import exact_dedup


def test_groups_ties_nulls_and_repeated_rows(spark):
    rows = [(5, "a b"), (2, "ab "), (9, "a  b"), (3, None), (4, ""), (7, "x" * 70 + "1"), (8, "x" * 70 + "2"), (8, "x" * 70 + "2"), (1, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in exact_dedup(docs, hash_unique=True).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
        assert len(r.text_sha256) == 64
    assert got[5] == [(9, 3, False)] and got[2] == [(9, 3, False)] and got[9] == [(9, 3, True)]
    assert got[4] == [(3, 2, False)] and got[3] == [(3, 2, True)]
    assert got[7] == [(7, 1, True)] and got[1] == [(1, 1, True)]
    assert sorted(got[8]) == [(8, 2, False), (8, 2, True)]


def test_unique_rows_are_not_hashed_unless_asked(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, "abcd"), (3, "ab c")], "doc_id long, text string")
    assert {r.doc_id: r.text_sha256 is None for r in exact_dedup(docs).collect()} == {1: False, 2: True, 3: False}


def test_empty_table_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, "abc", 7), (2, "a bc", 8)], "doc_id long, text string, _len int")
    assert exact_dedup(docs.limit(0)).count() == 0
    assert [(r.text, r._len) for r in exact_dedup(docs, carry=("text", "_len")).where("kept").collect()] == [("a bc", 8)]
