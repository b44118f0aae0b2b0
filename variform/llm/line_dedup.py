"""Repeated line runs, by a suffix array over line-ID sequences (DataFrame functions only).

A line's ID is its 64-bit hash. Lines that occur once cannot repeat and cut a document into stretches. Over the suffixes
of all stretches:

* Prefix doubling. A suffix's key at level k is the list of its ranks so far; the rank for its first 2**(k+1) lines is
  the place of the pair (rank for the first 2**k, key of the suffix 2**k lines on) among all distinct pairs, which are
  sorted by range over all partitions, so keys compare as suffixes do. Suffixes that are alone with their first lines
  are sorted and not ranked again; doubling goes on until every suffix is told from all others, or has ended.
* Prefix lengths. Suffixes of one rank at level k are a longest-common-prefix interval of 2**k lines or more. In every
  interval the first position (document, then line) has no earlier copy of that length. The length of the longest
  prefix that also stands earlier is found bit by bit: the members of an interval that are first in theirs of the next
  level are split by the rank of the lines that follow the shared ones, with one first member for reference in each
  part; a position that is not first in its part shares the longer prefix, one that is first only the shorter.
* Deletion. Where that longest earlier run has ``min_words`` words or more, it is deleted, in whole; the first copy stays.

Runs do not reach across documents; a run may overlap its own earlier copy. Lines are compared as they are. A line or
run that very many rows share is dealt over many tasks (salted joins; everything else is combined before it is shuffled).

Defined results: a null text stays null and an empty one empty; a document that loses all lines has an empty text;
rows that repeat an identifier with other text are ordered by a hash of the text, equal rows are treated as one and
get the same answer; rows with a null identifier are left as they are; an empty table gives an empty result; columns of
the input that are called as those that are added are replaced, all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BitFilter, checked_broadcast, drop_path, fresh, hot_keys, materialize, salted_join

MIN_WORDS = 50
DOC = ["id", "t"]
PLACE = ["id", "t", "pos"]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, t (text hash), pos, h (line ID), w (words) of every line."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    words = F.size(F.regexp_extract_all("line", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return rows.select("id", "t", "pos", F.xxhash64("line").alias("h"), words.alias("w"))


#: So few rows are ordered, and split by one key, in one task: the last rounds have no more.
FEW = 8192


def _ordered(df: DataFrame, keys: list[str], name: str, rank: str, most: int | None = None) -> tuple[DataFrame, str]:
    """df with rank: the number of its row in the order of keys over all partitions (increasing, with gaps). most: rows at most."""
    dealt = df.coalesce(1) if most is not None and most <= FEW else df.repartitionByRange(*keys)
    return materialize(dealt.sortWithinPartitions(*keys).withColumn(rank, F.monotonically_increasing_id()), name)


class SuffixArray:
    """The suffixes of the repeated lines of a table.

    ``lines``: id, t, pos, grp (stretch), last (line of its stretch), w (words) and cw (words of the stretch up to and with this line).
    ``levels[k]``: the suffixes that share their first 2**k lines with another: id, t, pos, r (rank), h (first position of
    that rank) and lead (is it the first of its rank at level k + 1, or alone there?)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.levels: list[DataFrame] = []
        self.paths: list[str] = []
        lines = _lines(docs, id_col, text_col)
        ranked, ranked_path = _ordered(lines.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), ["h"], "ids", "r")
        n_ids, n = ranked.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        maybe = BitFilter(ranked, "h", n_ids).keep(lines, F.col("h"))
        rows = salted_join(maybe, ranked.select("h", "r"), ["h"], hot_keys(ranked, ["h"], n), PLACE)
        rows = rows.groupBy(*PLACE).agg(F.first("w").alias("w"), F.first("r").alias("r"))  # equal rows are one
        rows = rows.withColumn("grp", F.col("pos") - F.row_number().over(Window.partitionBy(*DOC).orderBy("pos")))
        stretch = Window.partitionBy(*DOC, "grp")
        rows = rows.withColumns({"last": F.max("pos").over(stretch), "cw": F.sum("w").over(stretch.orderBy("pos"))})
        self.lines, path = materialize(rows, "suffixes")
        drop_path(docs.sparkSession, ranked_path)
        self.paths.append(path)
        self._double()

    def drop(self) -> None:
        for path in self.paths:
            drop_path(self.lines.sparkSession, path)

    def _double(self) -> None:
        """Ranks by the first 1, 2, 4, ... lines, until no two suffixes that go on are alike."""
        n = self.lines.count()
        lines = self.lines.select(*PLACE, "grp", "last", "r")
        groups, path = materialize(lines.groupBy("r").agg(F.count("*").alias("c"), F.min(F.struct(*PLACE)).alias("h")), "groups")
        self.paths.append(path)
        state = salted_join(lines, groups, ["r"], hot_keys(groups, ["r"], n), PLACE)
        state = state.select(*PLACE, "grp", "last", F.array("r").alias("key"), (F.col("c") > 1).alias("live"), "h")
        state, path = materialize(state, "level")
        self.paths.append(path)
        k = 0
        while live := state.where("live").count():
            state, path = self._ranked(state, k, live)
            self.paths.append(path)
            self.levels.append(state.where("was").select(*PLACE, F.get("key", F.lit(k)).alias("r"), F.col("led").alias("h"), (~F.col("live") | (F.col("h") == F.struct(*PLACE))).alias("lead")))
            k += 1

    def _ranked(self, state: DataFrame, k: int, n: int) -> tuple[DataFrame, str]:
        """The suffixes after the n live ones were ranked by 2**(k + 1) lines; live: whether that many are there and
        shared, was: before. Lines that no live suffix of their stretch reaches are left out."""
        span = 1 << k
        stretch = Window.partitionBy(*DOC, "grp")
        rows = state.withColumns({
            "nxt": F.coalesce(F.lead("key", span).over(stretch.orderBy("pos")), F.array().cast("array<bigint>")),
            "need": F.min(F.when(F.col("live"), F.col("pos"))).over(stretch), "r": F.element_at("key", -1),
        }).where("pos >= need")
        whole = F.col("pos") + 2 * span - 1 <= F.col("last")
        pairs = rows.where("live").groupBy("r", "nxt").agg(F.count("*").alias("c"), F.min(F.struct(*PLACE)).alias("f"), F.max(whole).alias("whole"))
        pairs, path = _ordered(pairs, ["r", "nxt"], "ranks", "n", n)
        self.paths.append(path)
        # ended and unique suffixes meet no pair: all ranks are 0 or more
        rows = rows.withColumn("r", F.when(F.col("live"), F.col("r")).otherwise(-1 - F.abs(F.xxhash64(*PLACE) % (1 << 60))))
        joined = salted_join(rows, pairs.withColumn("shared", F.col("c") > 1).drop("c"), ["r", "nxt"], hot_keys(pairs, ["r", "nxt"], n), PLACE, "left")
        after = joined.select(
            *PLACE, "grp", "last", F.when(F.col("live"), F.concat("key", F.array("n"))).otherwise(F.col("key")).alias("key"),
            (F.col("live") & F.coalesce(F.col("shared") & F.col("whole"), F.lit(False))).alias("live"), F.col("f").alias("h"), F.col("live").alias("was"), F.col("h").alias("led"),
        )
        return materialize(after, "level")

    def earlier(self) -> DataFrame:
        """(id, t, pos, l) of the positions whose first line also stands earlier, with the number of lines l from there that
        do so together: the longest prefix that the suffix shares with one of an earlier position."""
        shared = None
        for k in range(len(self.levels) - 1, -1, -1):
            new = self.levels[k].where("lead AND h != struct(id, t, pos)").select(*PLACE, "h", F.lit(1 << k).alias("l"))
            shared = new if shared is None else shared.unionByName(new)
            if not k:
                break
            shared, path = self._bit(shared, k - 1)
            self.paths.append(path)
        return self.lines.select(*PLACE).withColumn("l", F.lit(0)).limit(0) if shared is None else shared.select(*PLACE, "l")

    def _bit(self, shared: DataFrame, j: int) -> tuple[DataFrame, str]:
        """shared after deciding whether 2**j lines more are shared. A set (h, l) holds positions that share l lines with
        position h, the first of them, and that are first themselves for 2**(j + 1) more."""
        at = self.levels[j].select("id", "t", F.col("pos").alias("_at"), F.col("r").alias("y"))
        asked = shared.withColumn("_at", F.col("pos") + F.col("l")).join(at, ["id", "t", "_at"], "left").drop("_at")
        # a position that is alone with its next lines shares no more; it meets no part, as ranks are 0 or more
        asked = asked.withColumn("y", F.coalesce("y", -1 - F.abs(F.xxhash64(*PLACE) % (1 << 60))))
        asked, path = materialize(asked, "asked")
        self.paths.append(path)
        n = asked.count()
        parts = asked.where("y >= 0").groupBy("h", "l", "y").agg(F.count("*").alias("c"), F.min(F.struct(*PLACE)).alias("f"))
        heads = asked.where("y >= 0").select("h", "l").distinct().select("h", "l", F.col("h.id").alias("id"), F.col("h.t").alias("t"), (F.col("h.pos") + F.col("l")).alias("_at"))
        heads = heads.join(at, ["id", "t", "_at"]).select("h", "l", "y", F.lit(True).alias("own"))
        parts = parts.join(heads, ["h", "l", "y"], "left").select("h", "l", "y", "c", F.when(F.col("own"), F.col("h")).otherwise(F.col("f")).alias("f"))
        hot = {}
        if n > FEW:
            parts, path = materialize(parts, "parts")
            self.paths.append(path)
            hot = hot_keys(parts, ["h", "l", "y"], n)
        split = salted_join(asked, parts.drop("c"), ["h", "l", "y"], hot, PLACE, "left")
        more = F.coalesce(F.col("f") != F.struct(*PLACE), F.lit(False))
        return materialize(split.select(*PLACE, F.when(more, F.col("f")).otherwise(F.col("h")).alias("h"), F.when(more, F.col("l") + (1 << j)).otherwise(F.col("l")).alias("l")), "shared")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, str]:
    """(id, t, gone) with gone the sorted line numbers to delete, for the documents that have any; and its path."""
    array = SuffixArray(docs, id_col, text_col)
    runs = array.earlier().withColumn("end", F.col("pos") + F.col("l") - 1)
    to_end = array.lines.select("id", "t", F.col("pos").alias("end"), F.col("cw").alias("upto"))
    runs = runs.join(to_end, ["id", "t", "end"]).select(*PLACE, "end", "upto")
    reach = F.max(F.when(F.col("upto") - F.col("cw") + F.col("w") >= min_words, F.col("end"))).over(Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    gone = array.lines.select(*PLACE, "cw", "w").join(runs, PLACE, "left").withColumn("reach", reach).where("reach >= pos")
    made = materialize(gone.groupBy(*DOC).agg(F.sort_array(F.collect_list("pos")).alias("gone")), "gone")
    array.drop()
    return made


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of repeated runs deleted from text_col, and n_lines and n_removed (replaced if they clash)."""
    cols = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    gone, _ = repeated_lines(docs, id_col, text_col, min_words)
    n, size = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    own_id, own_t, own_gone = (fresh(c, docs.columns) for c in ("_id", "_t", "_gone"))
    gone = checked_broadcast(gone.select(F.col("id").alias(own_id), F.col("t").alias(own_t), F.col("gone").alias(own_gone)), 1, 40 * n + 4 * size)
    left = docs.select(*cols)
    text, listed = F.col(text_col), F.col(own_gone)
    joined = left.join(gone, (left[id_col] == gone[own_id]) & (F.xxhash64(text) == gone[own_t]), "left")
    lines = F.split(text, "\n")
    # the one-element transform binds the split lines, so that they are not split again for each line
    kept = F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), listed), lambda i: F.get(ls, i)), "\n")), F.lit(0))
    cleaned = F.when(listed.isNull(), text).otherwise(kept)
    n_lines = F.when(text.isNotNull(), F.size(lines)).otherwise(F.lit(0)).cast("long")
    removed = F.when(listed.isNotNull(), F.size(listed)).otherwise(F.lit(0))
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in cols], n_lines.alias("n_lines"), removed.cast("long").alias("n_removed"))
