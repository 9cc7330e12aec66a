"""Secrets in texts, and who else has them; DataFrame operations only.

Candidates are found by patterns, with spans in code points. Their SHA-256 is then counted over the
whole corpus by distinct repository and owner: a value that many owners hold is a widely copied
example, one that a single owner holds and that looks random may be live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, look_up, scratch

#: kind, pattern, group that holds the secret, its least number of characters.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds beyond the base, by the public formats of the tokens.
MORE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
)
KINDS = (*BASE, *MORE)
#: A value is a widely copied example from this many owners on.
WIDE_OWNERS = 3
#: A live-looking value has at least this many distinct characters.
LIVE_CHARACTERS = 8
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|^(.)\1+$"


def running_sums(numbers: Column) -> Column:
    """Sums of an array's first 1, 2, ... members, by doubling steps: n log n additions, no array that grows."""

    def doubled(sums: Column, k: Column) -> Column:
        back = F.pow(F.lit(2), k).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(F.lit(0)))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(2)))).cast("int") - 1)
    return F.aggregate(steps, numbers, doubled)


def spans(text: Column, kind: str, pattern: str, group: int, least: int, order: int) -> Column:
    """Leftmost matches of a pattern that do not overlap, as structs {begin, order, kind, finish, secret}.

    The parts between the matches and the matches themselves alternate, so running sums of their
    lengths in code points are the matches' places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    struct = "struct<begin:int,order:int,kind:string,finish:int,secret:string>"
    none = F.expr(f"cast(array() as array<{struct}>)")

    def placed(parts: Column) -> Column:
        stops = running_sums(F.transform(parts, lambda x: x["gap"] + F.coalesce(F.length(x["whole"]), F.lit(0))))
        held = lambda x, stop: F.struct((stop - F.length(x["whole"])).alias("begin"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), stop.alias("finish"), x["secret"].alias("secret"))
        each = F.zip_with(parts, stops, held)
        return F.filter(each, lambda x: x["begin"].isNotNull() & (F.length(x["secret"]) >= least))

    parts = F.arrays_zip(found.alias("whole"), secret.alias("secret"), gaps.alias("gap"))
    return F.when(F.regexp_like(text, F.lit(pattern)), F.element_at(F.transform(F.array(parts), placed), 1)).otherwise(none)


def find_secrets(docs: DataFrame, *, text_col: str = "text", kinds=KINDS, carry: list[str] | None = None) -> DataFrame:
    """Every document with ``secrets``, all spans by begin, then kind as listed; null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.sort_array(F.concat(*(spans(text, *kind, order) for order, kind in enumerate(kinds))))
    keep = [c for c in docs.columns if (carry is None or c in carry) and c.lower() != "secrets"]
    return docs.select(*[F.col(f"`{c}`") for c in keep], found.alias("secrets"))


def ownership(found: DataFrame, *, repo: Column, owner: Column, owners: int = WIDE_OWNERS) -> DataFrame:
    """One row per distinct secret: ``digest``, numbers of its occurrences, repositories and owners, ``verdict``.

    Occurrences are summed per (digest, repository, owner) before they are counted by digest, so a
    value that a third of all rows hold reaches its last task as a few rows per task.
    ``example``: held by ``owners`` owners or more, or a placeholder; ``live``: held by one owner and
    random-looking; else ``shared``.
    """
    one = found.select(repo.alias("repo"), owner.alias("owner"), F.explode("secrets.secret").alias("secret"))
    one = one.withColumns({
        "digest": F.unhex(F.sha2("secret", 256)),
        "placeholder": F.regexp_like("secret", F.lit(PLACEHOLDER)),
        "varied": F.size(F.array_distinct(F.split("secret", ""))) >= LIVE_CHARACTERS,
    })
    each = one.groupBy("digest", "repo", "owner").agg(F.count("*").alias("n"), F.max("placeholder").alias("placeholder"), F.max("varied").alias("varied"))
    by_owner = each.groupBy("digest", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("repos"), F.max("placeholder").alias("placeholder"), F.max("varied").alias("varied"))
    by_repo = each.groupBy("digest", "repo").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.sum("one").alias("n_repos")).withColumnRenamed("digest", "repo_digest")
    total = by_owner.groupBy("digest").agg(F.sum("n").alias("n_found"), F.count("*").alias("n_owners"), F.max("placeholder").alias("placeholder"), F.max("varied").alias("varied"))
    total = total.join(by_repo, F.col("digest") == F.col("repo_digest")).drop("repo_digest")
    verdict = F.when(F.col("placeholder") | (F.col("n_owners") >= owners), "example").when((F.col("n_owners") == 1) & F.col("varied"), "live").otherwise("shared")
    return total.select("digest", "n_found", "n_repos", "n_owners", verdict.alias("verdict"))


def scan(docs: DataFrame, *, text_col: str = "text", repo: Column | None = None, owner: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """Every document with its secrets and the verdicts on them.

    Adds ``secrets`` (array of structs begin, order, kind, finish, secret), ``n_live``, ``n_example``
    and ``n_shared`` long; columns of these names are replaced. ``owner`` defaults to the source,
    ``repo`` to source and language.

    Null text: no secrets. Null owners or repositories count as one each. Repeated rows are separate
    documents. Empty table: no rows. ``carry`` names the columns to keep; without texts among them
    what was found is cut, else it is landed as Parquet in the shared folder; texts are read once.
    """
    own = ("secrets", "n_live", "n_example", "n_shared")
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    keep = [c for c in docs.columns if (carry is None or c in carry) and c.lower() not in own]
    at_repo, at_owner, row, counted = fresh([*docs.columns, *own], "scan_repo", "scan_owner", "scan_row", "counted_row")
    placed = docs.withColumns({at_repo: repo, at_owner: owner})
    found = find_secrets(placed, text_col=text_col, carry=[*keep, at_repo, at_owner]).withColumn(row, F.monotonically_increasing_id())
    if text_col not in keep:
        found = cut(found)  # fixes the row numbers too
    else:
        landed = scratch(docs.sparkSession, "secrets")
        found.write.parquet(landed)
        found = docs.sparkSession.read.parquet(landed)
    narrow = cut(found.filter(F.size("secrets") > 0).select(F.col(row).alias("row"), F.col(at_repo).alias("repo"), F.col(at_owner).alias("owner"), "secrets"))
    verdicts = ownership(narrow, repo=F.col("repo"), owner=F.col("owner"))
    each = narrow.select("row", F.explode("secrets.secret").alias("secret")).select("row", F.unhex(F.sha2("secret", 256)).alias("held"))
    each = look_up(cut(each), "held", cut(verdicts), "digest")
    count = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).cast("long").alias(f"n_{v}")
    counts = each.groupBy("row").agg(count("live"), count("example"), count("shared")).withColumnRenamed("row", counted)
    joined = found.join(counts, F.col(row) == F.col(counted), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return joined.select(*[F.col(f"`{c}`") for c in keep], "secrets", zero("n_live"), zero("n_example"), zero("n_shared"))


def joined_spans(secrets: Column) -> Column:
    """kind:begin:finish of the spans, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["finish"].cast("string"))), ",")
