"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Candidates of fixed patterns are found in every text with their positions.  The
hashes of their values are counted over the corpus by distinct owners and
repositories: a value that many of them hold is a copied example, one that few
hold and that looks random is a live credential.  Candidates of the fixed kinds
always stay; generic tokens are reported only when they are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiller.llm.common import staged, text_or_empty

#: Fixed patterns.  A run of 32 or more hex digits is found whole, as is the rest
#: of an access key, so their length is part of the pattern; the value of an
#: assignment is measured after the match, for a short one uses up its text.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{24,}"
BASE = ("assign", "access", "hex")
MIN_VALUE = 8
#: A value held by more owners or repositories than this is a copied example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 4
#: A live-looking value has at least so many distinct characters, and digits.
MIN_DISTINCT = 8
#: Matches of one text whose positions are added up at a time.
BLOCK = 512

_SPAN = "struct<start:int,no:int,kind:string,stop:int,value:string>"


def _matches(pattern: str, group: int, possible: Column) -> Column:
    """Lengths of all matches, leftmost and without overlap, of the gaps before them, and values."""
    found = F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    parts = F.arrays_zip(
        F.transform(F.split("text", pattern, -1), F.char_length).alias("gap"),
        F.transform(found, F.char_length).alias("own"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"))
    # the last gap has no match
    return F.when(F.size(found) > 0, F.filter(parts, lambda x: x["own"].isNotNull()))


def _blocks(matches: str) -> Column:
    """A column of matches in blocks of BLOCK."""
    last = F.greatest(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    return F.when(F.size(matches) > 0, F.transform(
        F.sequence(F.lit(0), last),
        lambda b: F.slice(matches, b * BLOCK + 1, BLOCK)))


def _spans(no: int, kind: str, blocks: str) -> Column:
    """Spans of all matches in a column of blocks.

    The texts between the matches and the matches themselves, in turn, add up to
    the positions: first block by block, then within each, so that no list grows
    by one match at a time beyond a block.
    """
    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        stop = start + x["own"]
        span = F.struct(start.alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"),
                        stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    none = F.array().cast(f"array<{_SPAN}>")
    sums = F.transform(blocks, lambda m: F.aggregate(
        m, F.lit(0), lambda a, x: a + x["gap"] + x["own"]))
    starts = F.aggregate(
        sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, n: F.struct((a["at"] + n).alias("at"),
                              F.concat(a["starts"], F.array(a["at"])).alias("starts")),
        lambda a: a["starts"])
    each = F.transform(
        F.arrays_zip(F.col(blocks).alias("matches"), starts.alias("start")),
        lambda b: F.aggregate(b["matches"], F.struct(b["start"].alias("at"), none.alias("spans")),
                              step, lambda a: a["spans"]))
    return F.coalesce(F.flatten(each), none)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column
               ) -> DataFrame:
    """``(row, id, owner, repository, spans)`` of every row."""
    lowered = F.lower("text")
    names = F.lit(False)
    for name in ("passw", "secret", "token", "api"):
        names = names | lowered.contains(name)
    base = docs.select(F.col(id_col).alias("id"), owner.alias("owner"),
                       repository.alias("repository"), text_or_empty(F.col(text_col)).alias("text"))
    found = {
        "assign": _matches(ASSIGN, 2, names),
        "access": _matches(ACCESS, 0, F.col("text").contains("AKIA")),
        "hex": _matches(HEX, 0, F.lit(True)),
        "token": _matches(TOKEN, 0, F.lit(True)),
    }
    kept = ["id", "owner", "repository"]
    # a lambda evaluates what it closes over for each element, so every array it
    # looks into is a column of the step before
    matches = base.select(*kept, *(c.alias(kind) for kind, c in found.items()))
    blocks = matches.select(*kept, *(_blocks(kind).alias(kind) for kind in found))
    spans = {kind: _spans(no, kind, kind) for no, kind in enumerate(found)}
    kinds = [
        F.filter(spans["assign"], lambda s: F.char_length(s["value"]) >= MIN_VALUE),
        spans["access"], spans["hex"],
        F.filter(spans["token"], lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]")
                 & s["value"].rlike("[A-Z]")),
    ]
    return blocks.select(F.monotonically_increasing_id().alias("row"), *kept,
                         F.concat(*kinds).alias("spans"))


def live_looking(value: Column) -> Column:
    """Random-looking: digits and many distinct characters."""
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & (distinct >= MIN_DISTINCT)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         owner: Column | None = None, repository: Column | None = None,
         most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """``(id, spans)`` of every row: structs (start, kind, stop, value, live, n_owners).

    Positions count code points, the end is exclusive, spans are in order of
    their start, then of the kinds.  NULL and empty texts have none.  NULL owners
    and repositories count as one.  Repeated rows each give a row and count once.
    ``owner`` and ``repository`` default to the columns ``source`` and, within
    it, ``lang``; other columns are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.struct("source", "lang") if repository is None else repository
    found = staged(candidates(docs, id_col, text_col, owner, F.xxhash64(repository)),
                   "secret-candidates")
    each = found.select("row", "owner", "repository", F.explode("spans").alias("s")).withColumn(
        "hash", F.xxhash64("s.value"))
    held = each.select("hash", "owner", "repository").distinct()
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    counts = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"),
                                          F.sum("n").alias("n_repositories"))
    live = (live_looking(F.col("s.value")) & (F.col("n_owners") <= most_owners)
            & (F.col("n_repositories") <= most_repositories))
    marked = each.join(counts, "hash").select("row", F.struct(
        "s.start", "s.no", "s.kind", "s.stop", "s.value", live.alias("live"),
        "n_owners").alias("s"))
    reported = marked.where(F.col("s.kind").isin(*BASE) | F.col("s.live"))
    spans = reported.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return found.select("row", "id").join(spans, "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
