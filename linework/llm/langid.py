"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is cross-parsed against each:
from left to right into the longest phrases that occur in the labelled text. A phrase costs about
log2 of the labelled text's length in bits, so the language with the fewest phrases, so normalised,
describes the text best.

The labelled text is a bounded sample of labelled rows: their whole texts are cut into pieces of PIECE code
points, and of each language the pieces with the least hashes of (id, text, place) are learnt, LANGUAGE code
points of them, or TOTAL by the number of languages if that is less, but one piece at least. Every piece of
every labelled text is as likely as any other, and no language is left out; with more than
LANGUAGES of them the column can't be one of languages, and a ValueError says so. The sample is broadcast as text.
Tasks build the automata, one language at a time, and write them to the shared folder: dense transition tables where these are
small, else sorted edges. All Python workers of a machine map the same files, so a worker holds no automaton of its own.

A text is parsed whole. To step through many places at once it is cut into segments, each parsed from its own
beginning; where the parse of a segment really begins within a phrase of the one before, that phrase is
followed into the segment until both parses begin a phrase at the same place, from where they are one. A text
whose parses don't meet within a segment is parsed from front to back. So the phrases are those of the
unsegmented text.

Defined results: ``und`` with score 0 for a null text or one without letters, and for every text if
nothing is labelled; of equally good languages the first by name; a null label teaches nothing; null ids and
repeated rows are kept as they are, so repeated rows get repeated results; texts may be of any length; other
columns stay, but those named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.plans.tables import give_back, materialise, new_path, small_batches
from linework.sources.files import open_file, write_file

#: Different labels that are taken for languages: what is collected and broadcast has at least a piece of each.
LANGUAGES = 2_000
#: Code points of a piece of labelled text, and those learnt per language and over all of them.
PIECE, LANGUAGE, TOTAL = 2_000, 60_000, 1_200_000
#: Code points of a segment, and segments parsed together.
SEGMENT, ROWS = 512, 8192
#: Entries of a dense transition table.
DENSE = 1 << 24
UNKNOWN = "und"
#: How fast the score falls with a longer description: a language needing 1 + 1/SHARPNESS times the
#: bits has about a third of the weight.
SHARPNESS = 12.0


def held_out(id_col: str, parts: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0


@functools.cache
def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the lowered text, each run of other characters than letters as one space."""
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[found]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, found, 32)[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """For each state of the automaton of all substrings, symbol to state; state 0 is the root."""
    links, lengths, moves = [-1], [0], [{}]
    last = 0
    for c in symbols:
        lengths.append(lengths[last] + 1)
        links.append(0)
        moves.append({})
        cur, p = len(moves) - 1, last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = links[p]
        if p >= 0:
            q = moves[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[cur] = q
            else:
                lengths.append(lengths[p] + 1)
                links.append(links[q])
                moves.append(dict(moves[q]))
                clone = len(moves) - 1
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = links[p]
                links[q] = links[cur] = clone
        last = cur
    return moves


class Moves:
    """Transitions of an automaton for many states at once."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        self.width = width
        edges = sorted((state * width + c, to) for state, of in enumerate(moves) for c, to in of.items())
        self.keys = np.array([e[0] for e in edges], np.int64)
        self.to = np.array([e[1] for e in edges], np.int32)
        self.dense = None
        if len(moves) * width <= DENSE:
            self.dense = np.full(len(moves) * width, -1, np.int32)
            self.dense[self.keys] = self.to

    def write(self, path: str) -> None:
        """One file per array that is asked."""
        for name in ("keys", "to") if self.dense is None else ("dense",):
            np.save(to := io.BytesIO(), getattr(self, name))
            write_file(f"{path}-{name}.npy", to.getbuffer())

    @classmethod
    def read(cls, path: str, width: int) -> Moves:
        """The arrays are mapped where the folder is one of the machine's, and read from elsewhere."""

        def array(name: str) -> np.ndarray:
            with open_file(f"{path}-{name}.npy") as file:
                local = isinstance(file, io.FileIO)
                return np.asarray(np.load(file.name, mmap_mode="r") if local else np.load(io.BytesIO(file.read())))

        made = cls.__new__(cls)
        made.width, made.dense = width, None
        try:
            made.dense = array("dense")
        except FileNotFoundError:
            made.keys, made.to = array("keys"), array("to")
        return made

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        key = state.astype(np.int64) * self.width + symbol
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1).astype(np.int32)

    def phrases(self, symbols: np.ndarray) -> int:
        """Phrases of one text, front to back."""
        if self.dense is not None:
            get = memoryview(self.dense).__getitem__
        else:
            found = dict(zip(self.keys.tolist(), self.to.tolist(), strict=True))
            get = lambda key: found.get(key, -1)
        state, count, width = 0, 0, self.width
        for c in symbols.tolist():
            to = get(state * width + c)
            if state == 0 or to < 0:
                count += 1
                to = to if state == 0 else get(c)
            state = max(to, 0)
        return count


class CrossParser:
    """The automata of all languages over one alphabet, built here or read from the folder where write() put them."""

    def __init__(self, samples: list[tuple[str, str]], folder: str | None = None):
        self.points = {lang: codes(text) for lang, text in samples if text}
        self.langs = sorted(self.points)
        self.alphabet = np.unique(np.concatenate([*self.points.values(), np.array([32], np.uint32)]))
        self.width = len(self.alphabet) + 1  # the last symbol occurs nowhere
        self.folder = folder
        self.bits = np.array([np.log2(max(2, len(self.points[x]))) for x in self.langs])

    def table(self, k: int) -> Moves:
        return Moves(suffix_automaton(self.symbols(self.points[self.langs[k]]).tolist()), self.width)

    def write(self, k: int) -> None:
        """Build the automaton of one language for all."""
        self.table(k).write(f"{self.folder}/{k}")

    @functools.cached_property
    def tables(self) -> list[Moves]:
        all_of = range(len(self.langs))
        return [self.table(k) if self.folder is None else Moves.read(f"{self.folder}/{k}", self.width) for k in all_of]

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.int32)

    def phrases(self, table: Moves, steps: np.ndarray, active: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each segment (a column of ``steps``, the longest first; ``active`` of them
        are so long), as part of its text; and the segments where the parse could not be followed.
        ``after`` is the segment that a segment's open phrase runs into, or -1."""

        def walk(state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(next states, whether a phrase begins here)."""
            to = table.step(state, c)
            begins = (state == 0) | (to < 0)
            broken = np.flatnonzero((to < 0) & (state != 0))
            if len(broken):
                to[broken] = table.step(np.zeros(len(broken), np.int32), c[broken])
            return np.maximum(to, 0), begins

        state = np.zeros(steps.shape[1], np.int32)
        begins = np.zeros(steps.shape, bool)
        for t, n in enumerate(active):
            state[:n], begins[t, :n] = walk(state[:n], steps[t, :n])
        count = begins.sum(axis=0)
        lost = np.zeros(steps.shape[1], bool)
        lane = np.flatnonzero((after >= 0) & (state != 0))  # a segment's last phrase may run on
        state, into = state[lane], after[lane]
        for t, n in enumerate(active):
            on = into < n
            if not on.all():  # the text ends before the parses meet
                lane, state, into = lane[on], state[on], into[on]
            if not len(lane):
                break
            state, own = walk(state, steps[t, into])
            theirs = begins[t, into]
            count[into] += own.astype(np.int64) - theirs
            apart = ~(own & theirs)
            lane, state, into = lane[apart], state[apart], into[apart]
        lost[into[after[into] >= 0]] = True  # the next segment's beginning is not known
        return count, lost

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits for each text (row) by each language (column)."""
        whole = [self.symbols(codes(text)) for text in texts]
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        batch: list[int] = []
        size = 0
        for i, s in enumerate(whole):
            batch.append(i)
            size += -(-len(s) // SEGMENT)
            if size >= ROWS or i + 1 == len(whole):
                total[batch] = self._counts([whole[k] for k in batch])
                batch, size = [], 0
        return total * self.bits

    def _counts(self, texts: list[np.ndarray]) -> np.ndarray:
        cut = [(i, s[a : a + SEGMENT], a + SEGMENT < len(s)) for i, s in enumerate(texts) for a in range(0, len(s), SEGMENT)]
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if not cut:
            return total
        of = np.array([c[0] for c in cut])
        lengths = np.array([len(c[1]) for c in cut])
        order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        follows = np.array([k + 1 if c[2] else -1 for k, c in enumerate(cut)])
        after = np.where(follows >= 0, place[follows], -1)[order]
        steps = np.zeros((lengths.max(), len(cut)), np.int32)
        for column, k in enumerate(order):
            steps[: lengths[k], column] = cut[k][1]
        active = np.searchsorted(-lengths[order], -np.arange(1, len(steps) + 1), side="right")
        for k, table in enumerate(self.tables):
            count, lost = self.phrases(table, steps, active, after)
            np.add.at(total[:, k], of[order], count)
            for i in np.unique(of[order][lost]).tolist():
                total[i, k] = table.phrases(texts[i])
        return total


def labelled_sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(lang, text) of the pieces to learn from."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"), F.ceil(F.length(text_col) / PIECE).cast("int").alias("n")
    )
    counts = materialise(rows.groupBy("lang").agg(F.sum("n").alias("pieces")), "languages")
    if (languages := counts.count()) > LANGUAGES:
        raise ValueError(f"{languages} different languages in column {lang_col!r}, at most {LANGUAGES} can be learnt")
    most = max(1, min(LANGUAGE, TOTAL // max(1, languages)) // PIECE)
    share = F.least(F.lit(1.0), (3.0 * most + 20) / F.col("pieces"))
    few = rows.join(F.broadcast(counts), "lang").withColumn("share", share)  # a row per language
    places = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: F.pmod(F.xxhash64("h", k), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    few = few.select("lang", "text", "h", F.explode(places).alias("k"))
    few = few.select("lang", F.pmod(F.xxhash64("h", "k"), F.lit(1 << 40)).alias("h"), F.substring("text", (F.col("k") - 1) * PIECE + 1, F.lit(PIECE)).alias("text"))
    first = Window.partitionBy("lang").orderBy("h", "text")
    few = few.withColumn("k", F.row_number().over(first)).where(F.col("k") <= most)
    texts: dict[str, list[str]] = {}
    for r in few.orderBy("lang", "k").select("lang", "text").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return [(lang, "\n".join(of)) for lang, of in sorted(texts.items())]


def _write_automata(spark: SparkSession, shared: Broadcast, folder: str) -> None:
    """Build and write the automata in tasks, one language at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parser = CrossParser(shared.value, folder)
            for k in batch.column("id").to_pylist():
                parser.write(k)
            yield batch
        give_back()

    if n := sum(bool(text) for _, text in shared.value):
        spark.range(0, n, 1, min(n, spark.sparkContext.defaultParallelism)).mapInArrow(build, "id long").write.format("noop").mode("overwrite").save()


_parsers: dict[str, CrossParser | None] = {}


def identify(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", pred_col: str = "lang_pred", score_col: str = "lang_score"
) -> DataFrame:
    """``docs`` with ``pred_col`` and ``score_col``, in place of columns of these names; ``labelled`` has id,
    text and language to learn from."""
    spark = docs.sparkSession
    small_batches(spark, 4 << 20)
    docs = docs.drop(pred_col, score_col)
    shared = spark.sparkContext.broadcast(labelled_sample(labelled, id_col, text_col, lang_col))
    folder = new_path(spark, "language-automata")
    _write_automata(spark, shared, folder)
    key = uuid.uuid4().hex
    names = docs.columns
    where = names.index(text_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{pred_col}` string, `{score_col}` double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()  # a worker keeps the parser of one job
            _parsers[key] = CrossParser(shared.value, folder) if any(t for _, t in shared.value) else None
        parser = _parsers[key]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                texts = [t or "" for t in part.column(where).to_pylist()]
                lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))]
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if parser and lettered:
                    cost = parser.costs([texts[i] for i in lettered])
                    best = cost.argmin(axis=1)
                    least = cost.min(axis=1, keepdims=True)
                    weight = np.exp(-SHARPNESS * (cost - least) / np.maximum(least, 1))
                    share = 1 / weight.sum(axis=1)
                    for i, b, s in zip(lettered, best, share, strict=True):
                        pred[i], score[i] = parser.langs[b], float(s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred), pa.array(score, pa.float64())], [*names, pred_col, score_col])
        give_back()

    return docs.mapInArrow(predict, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), docs.where(~held_out("doc_id")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
