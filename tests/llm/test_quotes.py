import re

from linework.llm import quotes


def brute(messages):
    """(conv, turn) -> (reply_to, thread, depth, n_quotes, n_linked, body) with plain loops."""
    norm = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    own, quoted = {}, {}
    for conv, turn, text in messages:
        runs, mine = [], []
        for line in (text or "").split("\n"):
            mark = re.match(r"^[ \t]*(>[ \t]*)+", line)
            level = mark[0].count(">") if mark else 0
            if not level:
                mine.append(line)
            elif runs and runs[-1][0] == level and runs[-1][2]:
                runs[-1][1].append(line[mark.end() :])
            else:
                runs.append([level, [line[mark.end() :]], True])
            for r in runs[: -1 if level else None]:
                r[2] = False
        own[conv, turn] = "\n".join(mine).strip()
        quoted[conv, turn] = [(r[0], i, norm(" ".join(r[1]))) for i, r in enumerate(runs) if norm(" ".join(r[1]))]
    parent, linked = {}, {}
    for (conv, turn), found in quoted.items():
        hits = []
        for level, at, text in found:
            units = lambda b: {norm(u) for u in [b, *re.split(r"\n[ \t]*\n", b), *b.split("\n")]}
            first = min((t for (c, t), b in own.items() if c == conv and text in units(b)), default=None)
            if first is not None and first < turn:
                hits.append((level, at, first))
        linked[conv, turn] = len(hits)
        if hits:
            parent[conv, turn] = min(hits)[2]
    out = {}
    for (conv, turn), body in own.items():
        root, depth = turn, 0
        while (conv, root) in parent:
            root, depth = parent[conv, root], depth + 1
        out[conv, turn] = (parent.get((conv, turn)), root, depth, len(quoted[conv, turn]), linked[conv, turn], body)
    return out


THREAD = [
    (1, 0, "Hello there.\nHow are you?\n\nBye"),
    (1, 1, "> how  are\tYOU?\nFine."),
    (1, 2, "unrelated"),
    (1, 3, ">> How are you?\n> Fine.\n\nGood\n > unrelated"),
    (1, 4, "> Good\nDeep"),
    (1, 5, "> Hello there. How are you?\n> \n> Bye\nAll of it"),
    (1, 6, "> not found anywhere\nmine\n>\n"),
    (1, 7, "> Deep\n>> Good\n> Deep"),
    (2, 0, "> Fine.\nother conversation"),
    (2, 1, None),
    (2, 2, ""),
]


def test_fixture_equals_brute_force(spark):
    df = spark.createDataFrame([(c, t, "user", x, 5) for c, t, x in THREAD], "conv_id long, turn long, role string, text string, row int")
    rows = quotes.format_chat(df).collect()
    got = {(r.conv_id, r.turn): (r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked, r.body) for r in rows}
    assert got == brute(THREAD)
    assert got[1, 4][:3] == (3, 0, 3) and got[1, 3][:1] == (1,)
    ordered = [r.turn for r in sorted((r for r in rows if r.conv_id == 1), key=lambda r: r.position)]
    assert ordered == [t for _, t in sorted((v[1], k[1]) for k, v in got.items() if k[0] == 1)]
    assert rows[0].formatted == "<|user|>\n" + rows[0].body


def test_long_chain_and_derived_quotes(spark):
    df = spark.createDataFrame([(1, t, "user", (f"> word {t - 1}\n" if t else "") + f"word {t}") for t in range(70)], "conv_id long, turn long, role string, text string")
    assert [(r.depth, r.thread, r.position) for r in quotes.format_chat(df).orderBy("turn").collect()] == [(t, 0, t + 1) for t in range(70)]
    rows = quotes.quoted_replies(spark, "/root/testdata/sf0.001").collect()
    assert all(r.reply_to == r.turn - 1 for r in rows if r.turn) and all(r.n_linked == min(r.turn, 2) for r in rows)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, 0, None, "a"), (1, 0, None, "a"), (None, None, None, None), (None, 0, "x", "b"), (None, 1, "y", "> b\nc"), (1, 1, "u", "> a"), (1, 1, "u", "> a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id or 0, -1 if r.turn is None else r.turn, r.role, -1 if r.reply_to is None else r.reply_to, r.position) for r in quotes.format_chat(df).collect())
    assert got == [(0, -1, "user", -1, 1), (0, 0, "x", -1, 2), (0, 1, "y", 0, 3), (1, 0, "user", -1, 1), (1, 0, "user", -1, 2), (1, 1, "u", 0, 3), (1, 1, "u", 0, 4)]
    assert quotes.format_chat(df.limit(0)).count() == 0


EXCERPTS = [
    (1, 0, "a\nb\nc\nd\n\nlong line one\n\nx\ny"),
    (1, 1, "> a\n> b\nlines that are no whole paragraph"),
    (1, 2, "> long\n> line one\n> \n> x y\ntwo of three paragraphs, wrapped anew"),
    (1, 3, "> b\n> D\n>\n> x\nparts of two paragraphs"),
    (1, 4, "> d\n> a\nwrong order"),
    (1, 5, "> b\n> b\nonce in the original"),
    (1, 6, ">> c\n>> d\n> lines that are no whole paragraph\n> d\nno such lines together"),
    (1, 7, "> x y\n>\n> y\nthe paragraph is used up"),
    (1, 8, "a\nb\nlater"),
    (1, 9, "> a\n> b\nthe whole is not a unit of turn 8 either, the first is turn 0"),
    (1, 10, "> a\n> b\n> later\nas a whole"),
    (1, 11, "> b\n> later\nonly turn 8"),
    (2, 0, "> a\n> b\nother conversation"),
    (2, 1, "> p\n> q\nmine\np\nq\nr"),
    (None, 0, "k\nl\nm"),
    (None, 1, "> l\n> m\nnull conversation"),
]


def test_excerpts(spark):
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in EXCERPTS], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_linked) for r in quotes.format_chat(df).collect()}
    none = (None, 0)
    linked = {(1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 6): 0, (1, 9): 0, (1, 10): 8, (1, 11): 8, (None, 1): 0}
    assert got == {(c, t): (linked[c, t], 1) if (c, t) in linked else none for c, t, _ in EXCERPTS}


def test_excerpts_of_the_tables(spark):
    """Two lines in order, of every message that has them, are quoted by the next one."""
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    norm = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    lines = lambda t: [x for x in map(norm, t.split("\n")) if x]
    bodies, messages, expected = {}, [], {}
    for r in rows:
        words = (r.text or "").split()
        body = "\n".join(" ".join(words[i : i + 4]) for i in range(0, len(words), 4))
        before = bodies.get((r.conv_id, r.turn - 1), "")
        quote = before.split("\n")[1:-1:2]
        messages.append((r.conv_id, r.turn, r.role, "".join(f"> {x}\n" for x in quote) + body))
        bodies[r.conv_id, r.turn] = body
        if len(quote) > 1:

            def has(text):
                left = iter(lines(text))
                return all(x in left for x in lines("\n".join(quote)))

            expected[r.conv_id, r.turn] = min(t for (c, t), b in bodies.items() if c == r.conv_id and t < r.turn and has(b))
    got = quotes.format_chat(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()
    found = {(r.conv_id, r.turn): r.reply_to for r in got if (r.conv_id, r.turn) in expected}
    assert len(expected) > 20 and found == expected


def test_long_marks_and_lines(spark):
    """Marks and lines of 100,000 characters, and a conversation with a tie."""
    long = "x" * 100_000
    rows = [(1, 0, "u", long, 1), (1, 1, "u", f"> {long}\nmine", 1), (1, 2, "u", "> " * 50_000 + long + "\n>", 1), (1, 3, "u", ">" * 100_000, 1), (1, 3, "u", "> mine", 1), (1, 4, "u", "\n".join(["> a", "b"] * 5000), 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, level int")
    found = sorted(quotes.format_chat(df).collect(), key=lambda r: r.position)
    assert [r.position for r in found] == [1, 2, 3, 4, 5, 6]
    assert [(r.turn, r.reply_to, r.n_quotes, r.n_linked) for r in found if r.turn != 3] == [(0, None, 0, 0), (1, 0, 1, 1), (2, 0, 1, 1), (4, None, 5000, 0)]
    assert {(r.turn, r.reply_to, r.n_quotes) for r in found if r.turn == 3} == {(3, None, 0), (3, 1, 1)}


def test_long_runs_of_white_space(spark):
    """A million spaces, tabs or line ends within a message take one pass."""
    import time

    n = 1_000_000
    rows = [("c", 0, "a" + " " * n + "b"), ("c", 1, " \t" * (n // 2) + "x" + "\n" * 20), ("c", 2, "> " + "\t" * n), ("c", 3, "\n \n" * 2000 + "y")]
    own = spark.createDataFrame(rows, "conv_id string, turn int, text string").select(quotes.without_quotes(quotes.F.col("text")).alias("t"))
    own.limit(0).collect()
    began = time.perf_counter()
    assert [r.t for r in own.collect()] == ["a" + " " * n + "b", "x", "", "y"]
    assert time.perf_counter() - began < 20
