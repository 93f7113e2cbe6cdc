"""Append-only facts: current-state views, merge rules, transition checks, three-state resolution, guarded recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwise.operators.dedup import latest


def current(df: DataFrame, keys: list[str], at: str, tie: str, superseded: str | None = None) -> DataFrame:
    """The latest fact of each key; facts that another names in ``superseded`` are out."""
    if superseded:
        gone = df.where(F.col(superseded).isNotNull()).select(F.col(superseded).alias(tie)).distinct()
        df = df.join(gone, tie, "left_anti")
    return latest(df, keys, [at, tie])


def append_if_absent(store: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The store and those rows whose key it lacks, one for each key."""
    fresh = rows.join(store.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
    return store.unionByName(fresh, allowMissingColumns=True)


def upsert(store: DataFrame, rows: DataFrame, key: str, mode: str, at: str, state: str, terminal: list[str]) -> DataFrame:
    """Merge by mode: ``immutable`` keeps the first, ``mutable`` the latest, ``terminal`` the latest unless a terminal state came before."""
    both = store.unionByName(rows)
    rest = [c for c in both.columns if c != key]
    row = F.struct(F.col(at), F.struct(*rest).alias("row"))
    if mode == "immutable":
        pick = F.min(row)
    elif mode == "mutable":
        pick = F.max(row)
    else:
        pick = F.coalesce(F.min(F.when(F.col(state).isin(*terminal), row)), F.max(row))
    return both.groupBy(key).agg(pick.alias("_b")).select(key, "_b.row.*").select(*store.columns)


def transition_issues(df: DataFrame, key: str, order: list[str], state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Rows whose state may not follow the one before it."""
    steps = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs])
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn("before", before).where("before is not null")
    return rows.where(~F.array_contains(steps, F.concat(F.col("before"), F.lit(">"), F.col(state))))


def supersession_issues(df: DataFrame, key: str, at: str, tie: str, state: str, terminal: list[str], reason: Column) -> DataFrame:
    """Terminal states that changed later without a reason."""
    w = Window.partitionBy(key).orderBy(at, tie)
    rows = df.withColumn("before", F.lag(state).over(w))
    return rows.where(F.col("before").isin(*terminal) & (F.col("before") != F.col(state)) & ~F.coalesce(reason, F.lit(False)))


def three_state(keys: DataFrame, evidence: DataFrame, key: str, value: str) -> DataFrame:
    """RESOLVED with its value, CONFLICT or MISSING for each key, from the evidence's distinct values."""
    g = evidence.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias("_v"))
    j = keys.join(g, key, "left")
    status = F.when(F.coalesce("_n", F.lit(0)) == 0, "MISSING").when(F.col("_n") == 1, "RESOLVED").otherwise("CONFLICT")
    return j.select(*keys.columns, status.alias("status"), F.when(F.col("_n") == 1, F.col("_v")).alias(value))


def guard(df: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """Key and broken checks of the rows that break any (a check that is unknown counts as broken)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]), lambda x: x.isNotNull())
    return df.select(key, F.array_join(broken, ",").alias("broken")).where("broken <> ''")


def seal(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and an order-free digest of a projection: sums of two hashes of each row, so no order and no single task is needed."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = F.conv(F.substring(F.md5(line), 1, 12), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("digest"))


def missing_members(dims: DataFrame, facts: DataFrame, roles: list[dict[str, str]], key: str) -> DataFrame:
    """Members that facts name in any role but ``dims`` lacks: one row for each key, its least known attributes. A role maps the columns of ``dims`` to those of the facts."""
    named = None
    for role in roles:
        part = facts.select(*[F.col(source).alias(name) for name, source in role.items()])
        named = part if named is None else named.unionByName(part)
    rest = [c for c in named.columns if c != key]
    one = named.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*[F.col(c).isNull().alias(f"_no_{c}") for c in rest], *rest)).alias("_b"))
    return one.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest]).join(dims.select(key), key, "left_anti")


def backfill(store: DataFrame, staged: DataFrame, key: list[str], numbers: list[str]) -> tuple[DataFrame, DataFrame]:
    """Staged facts that the store lacks (one for each key), and the statistics of staged facts, old and new, that have any."""
    facts = staged.dropDuplicates(key).join(store.select(*key), key, "left_anti")
    known = store.select(*key).unionByName(facts.select(*key)).distinct()
    stats = staged.where(F.coalesce(*[F.col(c) for c in numbers]).isNotNull()).select(*key, *numbers).dropDuplicates(key)
    return facts, stats.join(known, key, "left_semi")


def resolve_or_create(names: DataFrame, known: DataFrame, name: str, target: str, least: int = 5) -> DataFrame:
    """``target`` and ``status`` of each distinct name: known (named once), ambiguous (several bear it, listed in ``candidates``), created (nobody does; the id is a hash of the name, below zero), or short."""
    held = known.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set(target)).alias("_ids"))
    found = names.select(F.trim(name).alias(name)).distinct().join(held, name, "left")
    status = F.when(F.col("_n") == 1, "known").when(F.col("_n") > 1, "ambiguous").when(F.length(name) >= least, "created").otherwise("short")
    made = -1 - F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("bigint")
    return found.select(name, F.when(status == "known", F.col("_ids")[0]).when(status == "created", made).alias(target), status.alias("status"), F.when(status == "ambiguous", F.col("_ids")).alias("candidates"))


def replace_by_key(store: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The store with the last row of each key that comes in, in place of its own."""
    last = latest(rows, [key], order)
    return store.join(last.select(key), key, "left_anti").select(*store.columns).unionByName(last.select(*store.columns))


def write_issues(store: DataFrame, writes: DataFrame, key: str, op: str, state: str, sha: str, terminal: list[str]) -> DataFrame:
    """The first rule that each write breaks: facts are never deleted, a record hash is 64 hex digits, one key has one hash for good, and a terminal state does not change."""
    held = store.select(F.col(key).alias("_key"), F.col(state).alias("_state"), F.col(sha).alias("_sha"))
    rows = writes.join(held, writes[key] == held["_key"], "left")
    there, differs = F.col("_key").isNotNull(), ~F.col(sha).eqNullSafe(F.col("_sha"))
    broken = (
        F.when(F.col(op) == "delete", "delete")
        .when(~F.coalesce(F.col(sha).rlike("^[0-9a-f]{64}$"), F.lit(False)), "hash")
        .when(there & F.col("_state").isin(*terminal) & differs, "terminal")
        .when(there & (F.col(op) == "insert") & differs, "contradiction")
    )
    return rows.withColumn("issue", broken).where("issue is not null").select(*writes.columns, "issue")
