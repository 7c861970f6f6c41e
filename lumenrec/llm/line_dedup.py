"""Line dedup: content-defined chunks of lines that the corpus has had before are removed. Native Spark only.

A text is cut into lines and these after each sentence; blank lines go with the
line before them. At every line a rolling hash is taken over the hashes of the line
and of the next one, with what parts them; a line that has `min_words` words has a
hash by itself too. A rolling hash is repeated if an earlier one (by doc_id, then
place) equals it.

Rolling hashes choose the chunks: a chunk goes on while they are repeated and their
first places follow each other as well, and a boundary is where that ends. Since a
rolling hash depends on nothing that stands before or after its two lines, the
boundaries move with the text: a passage of whole lines or sentences makes the same
chunk wherever it stands, its first and last line included. (Boundaries where a
rolling hash has a fixed remainder, as for files, leave the lines before the first
and after the last boundary of a passage in chunks with foreign lines: of passages
of 55 to 80 words up to 27 in 100 then hold no whole chunk and are missed.)

A chunk's text is compared byte by byte with that at its first place. Runs of
repeated text with at least `min_words` words are removed; the first copy of
everything stays. Shorter repeats, such as one common line, stay too, and so do
common lines in a new order.

Hot hashes: counts and first places are aggregated before they are shuffled; the
join that marks copies is a plain equi-join that can be split, and the one that
brings a chunk's text is dealt into parts; no group is gathered. Hashes and
places travel without text; texts are dealt by document, once where `docs` has no
further columns, and of them only segments that are repeated.

Odd input: null text stays null and is no line; an empty text stays; rows of the
same doc_id and text are one document, and either keeps what the other keeps; a
null doc_id comes after all others; a text of nothing but repeats becomes empty;
all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

MIN_WORDS = 50
#: Copies of a segment that are compared in one part.
COPIES = 500


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lines(text: Column) -> Column:
    """line: the lines and sentences of a text without what parts them; kind: 0 at the end of a line of the text, 1 for a sentence before it.

    The pattern begins with the space, which is quicker to look for than a place between, and looks back from a mark only.
    """
    parts = F.transform(F.split(text, "\n"), lambda x: F.split(x, " (?<=[.!?] )"))
    kind = lambda p: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, 1).otherwise(0))
    return let(parts, lambda p: F.struct(F.flatten(p).alias("line"), F.flatten(F.transform(p, kind)).alias("kind")))


def _parted(s: Column) -> Column:
    """The lines with what follows them: a space, a line end, after the last nothing."""
    last = F.size(s["line"]) - 1
    return F.transform(s["line"], lambda x, i: F.when(i == last, x).when(F.get(s["kind"], i) == 0, F.concat(x, F.lit("\n"))).otherwise(F.concat(x, F.lit(" "))))


def _begins(s: Column) -> Column:
    """Numbers of the lines that are not blank, and of the first. The first byte nearly always settles it."""
    return F.filter(F.sequence(F.lit(0), F.size(s["line"]) - 1), lambda i: (i == 0) | (F.get(s["line"], i) >= "!") | F.get(s["line"], i).rlike(r"\S"))


def seeds_of(text: Column, min_words: int = MIN_WORDS) -> Column:
    """pairs: hashes of the k-th line that is not blank and the next one, for every k but the last; singles: (at, h), at 2 k the hash of the k-th by itself if it has min_words words."""

    def hashed(s: Column) -> Column:
        def each(b: Column, hashes: Column) -> Column:
            def pair(i: Column, k: Column) -> Column:
                j = F.get(b, k + 1)
                near = F.xxhash64(F.get(hashes, i), F.get(s["kind"], i), F.get(hashes, j))
                far = F.xxhash64(F.slice(hashes, i + 1, j - i + 1), F.slice(s["kind"], i + 1, j - i))
                return F.when(j == i + 1, near).otherwise(far)

            def single(i: Column, k: Column) -> Column:
                line = F.get(s["line"], i)
                whole = (F.length(line) >= 2 * min_words - 1) & (words_in(line) >= min_words)
                return F.when(whole, F.struct((2 * k).alias("at"), F.xxhash64(F.get(hashes, i)).alias("h")))

            singles = F.filter(F.transform(b, single), lambda x: x.isNotNull())
            return F.struct(F.transform(F.slice(b, F.lit(1), F.size(b) - 1), pair).alias("pairs"), singles.alias("singles"))

        return let(_begins(s), lambda b: let(F.transform(s["line"], lambda x: F.xxhash64(x)), lambda hashes: each(b, hashes)))

    return let(_lines(text), hashed)


def lines_of(text: Column) -> Column:
    """Lines and sentences with their ends. Joined they give the text again."""
    return let(_lines(text), _parted)


def chunks_of(text: Column) -> Column:
    """Array of (begin, line, text) of the lines that are not blank: text with all that follows up to the next one."""

    def each(s: Column, x: Column) -> Column:
        def of(b: Column) -> Column:
            end = lambda k: F.coalesce(F.get(b, k + 1), F.size(x))
            return F.transform(b, lambda i, k: F.struct(i.alias("begin"), F.get(s["line"], i).alias("line"), F.when(end(k) == i + 1, F.get(x, i)).otherwise(F.concat_ws("", F.slice(x, i + 1, end(k) - i))).alias("text")))

        return let(_begins(s), of)

    return let(_lines(text), lambda s: let(_parted(s), lambda x: each(s, x)))


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def _segment(chunks: Column, begin: Column, n: Column) -> Column:
    """The text of n chunks, without what follows the last."""
    return F.concat_ws("", F.transform(F.slice(chunks, begin + 1, n - 1), lambda x: x["text"]), F.get(chunks, begin + n - 1)["line"])


def without_runs(chunks: Column, same: Column, min_words: int) -> Column:
    """The text without runs of at least min_words words that first copies have too.

    same: array of (begin, n, text), the first copy's text for n chunks from begin on.
    """

    def runs(c: Column) -> Column:
        equal = F.filter(same, lambda x: _segment(c, x["begin"], x["n"]) == x["text"])
        places = F.array_sort(F.transform(equal, lambda x: F.struct(x["begin"].alias("a"), (x["begin"] + x["n"]).alias("b"))))
        state = lambda done, a, b: F.struct(done.alias("done"), a.alias("a"), b.alias("b"))
        last = lambda s: F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["b"].alias("b"))))
        merge = lambda s, x: F.when(x["a"] <= s["b"], state(s["done"], s["a"], F.greatest(s["b"], x["b"]))).otherwise(state(last(s), x["a"], x["b"]))
        joined = F.aggregate(places, state(F.expr("cast(array() AS array<struct<a: int, b: int>>)"), F.lit(0), F.lit(0)), merge, last)
        long = F.filter(joined, lambda r: let(text_of(c, r["a"], r["b"]), enough))
        return F.struct(c.alias("c"), long.alias("runs"))

    def text_of(c: Column, a: Column, b: Column) -> Column:
        return F.concat_ws("", F.transform(F.slice(c, a + 1, b - a), lambda x: x["text"]))

    def enough(run: Column) -> Column:
        # the begin of a run nearly always settles it
        return (F.length(run) >= 2 * min_words - 1) & ((words_in(F.substring(run, 1, 12 * min_words)) > min_words) | (words_in(run) >= min_words))

    def rest(s: Column) -> Column:
        begin = lambda k: F.coalesce(F.get(s["runs"], k - 1)["b"], F.lit(0))
        end = lambda k: F.coalesce(F.get(s["runs"], k)["a"], F.size(s["c"]))
        kept = F.transform(F.sequence(F.lit(0), F.size(s["runs"])), lambda k: text_of(s["c"], begin(k), end(k)))
        return F.concat_ws("", kept)

    return let(let(chunks, runs), rest)


def repeated_segments(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, a, begin, n, f_doc, f_a, f_begin, parts: n chunks of a document from begin on whose seeds stand first in another place; a hashes the text."""
    hashed = docs.filter("text <> ''").select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("a"), seeds_of(F.col("text"), min_words).alias("s"))
    hashed = staged(hashed, "seeds")  # a row for each document: a row for each seed takes twice the time to write
    pairs = hashed.select("doc", "a", F.posexplode("s.pairs").alias("k", "h")).select("doc", "a", (2 * F.col("k") + 1).alias("at"), "h")
    seeds = pairs.union(hashed.select("doc", "a", F.inline("s.singles")))
    place = F.struct(F.col("doc").isNull().alias("null"), "doc", "a", "at")
    hashes = seeds.groupBy("h").agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("f")).filter("copies > 1")
    found = seeds.join(staged(hashes, "hashes"), "h").filter(F.col("f") != place)
    found = found.select("doc", "a", "at", F.col("f.doc").alias("f_doc"), F.col("f.a").alias("f_a"), F.col("f.at").alias("f_at"), F.ceil(F.col("copies") / COPIES).cast("int").alias("parts"))
    along = Window.partitionBy("doc", "a").orderBy(F.col("at") % 2, "at")
    before = F.lag(F.struct("at", "f_doc", "f_a", "f_at")).over(along)
    step = F.col("at") - before["at"]  # 0 in a row that is there twice, 2 from pair to pair; from a line by itself no run goes on
    goes_on = before["f_doc"].eqNullSafe(F.col("f_doc")) & (before["f_a"] == F.col("f_a")) & (step == F.col("f_at") - before["f_at"]) & step.isin(F.lit(0), F.col("at") % 2 * 2)
    found = found.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("nth", F.sum("new").over(along))
    # along a run places rise together, so the least ones are those of its first seed; buffers of fixed width need no sort
    one = found.groupBy("doc", "a", "nth").agg(F.min("at").alias("at"), F.min("f_at").alias("f_at"), F.min("parts").alias("parts"), F.max("at").alias("last"), F.first("f_doc").alias("f_doc"), F.first("f_a").alias("f_a"))
    half = lambda c: F.shiftright(c, 1)
    n = half(F.col("last") - F.col("at")) + 1 + F.col("at") % 2
    return staged(one.select("doc", "a", half(F.col("at")).alias("begin"), n.alias("n"), "f_doc", "f_a", half(F.col("f_at")).alias("f_begin"), "parts"), "segments")


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated passages of min_words words or more removed from `text`; other columns as they are."""
    segments = repeated_segments(docs.select("doc_id", "text"), min_words)
    # further columns of docs travel under numbers, so that none can clash with those used here
    names = {"doc_id": "id", "text": "text"} | {c: f"further_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    keyed = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in names.items()), F.xxhash64("text").alias("hash"))
    here = F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("a"))

    # the texts that segments must equal, from the documents that hold them first
    wanted = segments.groupBy(F.col("f_doc").alias("doc"), F.col("f_a").alias("a")).agg(F.collect_set(F.struct("f_begin", "n", "parts")).alias("wanted"))
    pieces = keyed.select("id", "text", "hash").join(wanted, here).select("doc", "a", "wanted", chunks_of(F.col("text")).alias("c"))
    pieces = pieces.select(F.col("doc").alias("f_doc"), F.col("a").alias("f_a"), F.inline(F.transform("wanted", lambda w: F.struct(w["f_begin"].alias("f_begin"), w["n"].alias("n"), w["parts"].alias("parts"), _segment(F.col("c"), w["f_begin"], w["n"]).alias("same")))))
    pieces = pieces.groupBy("f_doc", "f_a", "f_begin", "n").agg(F.first("same").alias("same"), F.first("parts").alias("parts"))
    # the later copies of a segment are dealt into parts, and its first copy goes to each of them
    pieces = pieces.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("most", words_in(F.col("same")))
    later = segments.withColumn("part", F.pmod(F.xxhash64("doc", "a"), F.col("parts")).cast("int")).drop("parts")
    keys = [later[c].eqNullSafe(pieces[c]) for c in ("f_doc", "f_a", "f_begin", "n", "part")]
    same = later.join(pieces, keys).select(later["doc"], later["a"], later["begin"], later["n"], "same", "most")
    same = same.groupBy("doc", "a").agg(F.collect_list(F.struct("begin", "n", F.col("same").alias("text"))).alias("same"), F.sum("most").alias("most"))
    same = same.filter(F.col("most") >= min_words).drop("most")  # with fewer words no run can be long enough

    text = F.when(F.col("same").isNull(), F.col("text")).otherwise(without_runs(chunks_of(F.col("text")), F.col("same"), min_words))
    return keyed.join(same, here, "left").withColumn("text", text).select(*(F.col(names[c]).alias(c) for c in docs.columns))
