"""Slowly changing dimensions, types 1 to 6 and metadata bags, as DataFrame -> DataFrame functions.

Every function takes the dimension's current state and a batch, and returns the whole
next state, so that a sink swaps it in at once.  Natural keys are lists of columns and
join null-safe.  A batch with several rows of a key must name an order
(``deduplicate_by``); without one that is an error of the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import SCDError
from .numbering import numbered

AUDIT = ("checksum", "is_current", "valid_from", "valid_to")


def row_hash(cols: list[str], alias: str = "") -> Column:
    """md5 of the columns in name order, as text, nulls empty, joined by |."""
    pick = lambda c: F.col(f"{alias}.`{c}`" if alias else f"`{c}`")
    return F.md5(F.concat_ws("|", *(F.coalesce(pick(c).cast("string"), F.lit("")) for c in sorted(cols))))


def deduplicated(batch: DataFrame, nk: list[str], by: str) -> DataFrame:
    """The last row of each key by an order."""
    return batch.withColumn("_r", F.row_number().over(W.partitionBy(*nk).orderBy(F.desc(by)))).filter("_r = 1").drop("_r")


def same_key(nk: list[str], a: str, b: str) -> Column:
    out = F.lit(True)
    for c in nk:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def classified(current: DataFrame, batch: DataFrame, nk: list[str], tracked: list[str], inferred: str | None = None) -> DataFrame:
    """The batch with its checksum and _class: new, changed, reconnect or unchanged against the current rows."""
    slim = current.filter("is_current").select(*nk, F.col("checksum").alias("_old"), *([F.coalesce(F.col(inferred), F.lit(False)).alias("_inf")] if inferred else [F.lit(False).alias("_inf")]), F.lit(True).alias("_known"))
    b = batch.withColumn("checksum", row_hash(tracked))
    j = b.alias("b").join(slim.alias("s"), same_key(nk, "b", "s"), "left")
    kind = F.when(F.col("s._known").isNull(), "new").when(F.col("s._inf"), "reconnect").when(F.col("b.checksum") != F.col("s._old"), "changed").otherwise("unchanged")
    return j.select("b.*", kind.alias("_class"))


def updated(current: DataFrame, rows: DataFrame, nk: list[str], columns: list[str]) -> DataFrame:
    """Columns of current rows with the values of ``rows`` (one a key); other rows stay as they are."""
    hit = F.col("u._hit").isNotNull() & F.col("t.is_current")
    swap = {x: F.when(hit, F.col(f"u.{x}")).otherwise(F.col(f"t.{x}")) for x in columns}
    u = rows.select(*nk, *columns).withColumn("_hit", F.lit(True))
    return current.alias("t").join(u.alias("u"), same_key(nk, "t", "u"), "left").select(*(swap.get(x, F.col(f"t.{x}")).alias(x) for x in current.columns))


def rotated(current: DataFrame, rows: DataFrame, nk: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Of each pair (now, before) of current rows before <- now and now <- the row's value."""
    hit = F.col("u._hit").isNotNull() & F.col("t.is_current")
    swap = {}
    for now, before in pairs:
        swap[before] = F.when(hit, F.col(f"t.{now}")).otherwise(F.col(f"t.{before}"))
        swap[now] = F.when(hit, F.col(f"u.{now}")).otherwise(F.col(f"t.{now}"))
    u = rows.select(*nk, *(a for a, _ in pairs)).withColumn("_hit", F.lit(True))
    return current.alias("t").join(u.alias("u"), same_key(nk, "t", "u"), "left").select(*(swap.get(x, F.col(f"t.{x}")).alias(x) for x in current.columns))


def plan(current: DataFrame, batch: DataFrame, nk: list[str], tracked: list[str], as_of: str, inferred: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(to_close, to_insert) of type 2: current rows that end at ``as_of``, and rows that come in as new versions."""
    c = classified(current, batch, nk, tracked, inferred)
    ends = current.filter("is_current").alias("t").join(c.filter("_class = 'changed'").select(*nk).alias("m"), same_key(nk, "t", "m"), "left_semi")
    return ends, _opened(c.filter("_class IN ('new', 'changed')"), as_of, current, {inferred: F.lit(False)} if inferred else None)


def applied(kind: int | str, current: DataFrame, batch: DataFrame, nk: list[str], tracked, as_of: str, **options) -> DataFrame:
    """The next state by a dimension's type.

    ``tracked`` is a list of columns (types 1, 2 and "metadata"), of (now, before) pairs
    (type 3), or a pair of lists, overwritten and versioned columns (type 6).
    """
    if options.get("deduplicate_by") and kind != 2:
        batch = deduplicated(batch, nk, options.pop("deduplicate_by"))
    if kind == 1:
        return scd1(current, batch, nk, list(tracked), as_of)
    if kind == 2:
        return scd2(current, batch, nk, list(tracked), as_of, **options)
    if kind == 3:
        return scd3(current, batch, nk, list(tracked), as_of)
    if kind == 6:
        return scd6(current, batch, nk, list(tracked[0]), list(tracked[1]), as_of)
    if kind == "metadata":
        return scd_metadata(current, batch, nk, list(tracked), as_of)
    raise SCDError(f"no slowly changing dimension of type {kind!r}")


def scd1(current: DataFrame, batch: DataFrame, nk: list[str], tracked: list[str], as_of: str) -> DataFrame:
    """Overwrite tracked columns of current rows; new keys are inserted.  The checksum follows."""
    c = classified(current, batch, nk, tracked)
    upd = c.filter("_class = 'changed'").select(*nk, *tracked, "checksum")
    new = _opened(c.filter("_class = 'new'"), as_of, current)
    hit = F.col("u.checksum").isNotNull() & F.col("t.is_current")
    swap = {**{x: F.when(hit, F.col(f"u.{x}")).otherwise(F.col(f"t.{x}")) for x in (*tracked, "checksum")}}
    out = current.alias("t").join(upd.alias("u"), same_key(nk, "t", "u"), "left").select(*(swap.get(x, F.col(f"t.{x}")).alias(x) for x in current.columns))
    return out.unionByName(new)


def _opened(rows: DataFrame, as_of: str, like: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows as new current versions with the columns of the dimension."""
    kind = dict((f.name, f.dataType) for f in like.schema.fields)
    given = {"is_current": F.lit(True), "valid_from": F.lit(as_of).cast(kind["valid_from"]), "valid_to": F.lit(None).cast(kind["valid_to"])} | (extra or {})
    have = set(rows.columns)
    return rows.select(*((given[c] if c in given else F.col(c) if c in have else F.lit(None).cast(kind[c])).alias(c) for c in like.columns))


def close_versions(current: DataFrame, keys: DataFrame, nk: list[str], as_of: str) -> DataFrame:
    """Current rows of the keys end at ``as_of``."""
    marks = keys.select(*nk).distinct().withColumn("_hit", F.lit(True))
    hit = F.col("m._hit").isNotNull() & F.col("t.is_current")
    kind = current.schema["valid_to"].dataType
    swap = {"is_current": F.when(hit, F.lit(False)).otherwise(F.col("t.is_current")), "valid_to": F.when(hit, F.lit(as_of).cast(kind)).otherwise(F.col("t.valid_to"))}
    return current.alias("t").join(marks.alias("m"), same_key(nk, "t", "m"), "left").select(*(swap.get(x, F.col(f"t.{x}")).alias(x) for x in current.columns))


def scd2(current: DataFrame, batch: DataFrame, nk: list[str], tracked: list[str], as_of: str, deduplicate_by: str | None = None, inferred: str | None = None) -> DataFrame:
    """New versions for new and changed keys, changed ones' old versions closed; inferred members are filled in place."""
    if deduplicate_by:
        batch = deduplicated(batch, nk, deduplicate_by)
    c = classified(current, batch, nk, tracked, inferred)
    out = close_versions(current, c.filter("_class = 'changed'"), nk, as_of)
    if inferred:
        fill = c.filter("_class = 'reconnect'").select(*nk, *tracked, "checksum")
        hit = F.col("u.checksum").isNotNull() & F.col("t.is_current")
        swap = {x: F.when(hit, F.col(f"u.{x}")).otherwise(F.col(f"t.{x}")) for x in (*tracked, "checksum")} | {inferred: F.when(hit, F.lit(False)).otherwise(F.col(f"t.{inferred}"))}
        out = out.alias("t").join(fill.alias("u"), same_key(nk, "t", "u"), "left").select(*(swap.get(x, F.col(f"t.{x}")).alias(x) for x in current.columns))
    return out.unionByName(_opened(c.filter("_class IN ('new', 'changed')"), as_of, current, {inferred: F.lit(False)} if inferred else None))


def scd3(current: DataFrame, batch: DataFrame, nk: list[str], pairs: list[tuple[str, str]], as_of: str) -> DataFrame:
    """Rotate: previous <- current value, current <- new value, where any of the pairs' values changed."""
    tracked = [a for a, _ in pairs]
    c = classified(current, batch, nk, tracked)
    upd = c.filter("_class = 'changed'").select(*nk, *tracked, "checksum")
    hit = F.col("u.checksum").isNotNull() & F.col("t.is_current")
    swap = {"checksum": F.when(hit, F.col("u.checksum")).otherwise(F.col("t.checksum"))}
    for now, before in pairs:
        swap[before] = F.when(hit, F.col(f"t.{now}")).otherwise(F.col(f"t.{before}"))
        swap[now] = F.when(hit, F.col(f"u.{now}")).otherwise(F.col(f"t.{now}"))
    out = current.alias("t").join(upd.alias("u"), same_key(nk, "t", "u"), "left").select(*(swap.get(x, F.col(f"t.{x}")).alias(x) for x in current.columns))
    return out.unionByName(_opened(c.filter("_class = 'new'"), as_of, current))


def upsert_profiles(mini: DataFrame, batch: DataFrame, profile: list[str], sk: str = "id") -> DataFrame:
    """The mini-dimension with the batch's missing combinations added, numbered on from its largest key in column order."""
    missing = batch.select(*profile).distinct().alias("b").join(mini.alias("m"), same_key(profile, "b", "m"), "left_anti")
    top = mini.agg(F.coalesce(F.max(sk), F.lit(0)).alias("_top"))
    new = numbered(missing.select(*profile), profile, "_n").crossJoin(F.broadcast(top))  # one row
    kind = mini.schema[sk].dataType
    return mini.select(sk, *profile).unionByName(new.select((F.col("_top") + F.col("_n")).cast(kind).alias(sk), *profile))


def scd4(mini: DataFrame, base: DataFrame, batch: DataFrame, nk: list[str], profile: list[str], tracked: list[str], as_of: str, sk: str = "id", fk: str = "profile_sk") -> tuple[DataFrame, DataFrame]:
    """(mini-dimension, base dimension): profiles split off, the base versioned with the profile's key."""
    new_mini = upsert_profiles(mini, batch, profile, sk)
    tied = batch.alias("b").join(new_mini.alias("m"), same_key(profile, "b", "m")).select(*(F.col(f"b.{c}") for c in batch.columns if c not in profile), F.col(f"m.{sk}").alias(fk))
    return new_mini, scd2(base, tied, nk, [*tracked, fk], as_of)


def scd5(mini: DataFrame, base: DataFrame, batch: DataFrame, nk: list[str], profile: list[str], tracked: list[str], as_of: str, pointer: str = "current_profile_sk", **kw) -> tuple[DataFrame, DataFrame]:
    """Type 4 with a pointer to the current profile on every version of a key."""
    fk = kw.get("fk", "profile_sk")
    new_mini, out = scd4(mini, base, batch, nk, profile, tracked, as_of, **kw)
    now = out.filter("is_current").select(*nk, F.col(fk).alias("_now"))
    out = out.alias("t").join(now.alias("n"), same_key(nk, "t", "n"), "left")
    return new_mini, out.select(*((F.coalesce("n._now", f"t.{pointer}") if c == pointer else F.col(f"t.{c}")).alias(c) for c in base.columns))


def scd6(current: DataFrame, batch: DataFrame, nk: list[str], overwrite: list[str], version: list[str], as_of: str) -> DataFrame:
    """A change of ``version`` columns opens a version; one of ``overwrite`` columns alone changes the current row."""
    slim = current.filter("is_current").select(*nk, row_hash(overwrite).alias("_h1"), row_hash(version).alias("_h2"))
    b = batch.withColumns({"checksum": row_hash([*overwrite, *version]), "_n1": row_hash(overwrite), "_n2": row_hash(version)})
    kind = F.when(F.col("s._h1").isNull(), "new").when(F.col("b._n2") != F.col("s._h2"), "version").when(F.col("b._n1") != F.col("s._h1"), "overwrite").otherwise("unchanged")
    c = b.alias("b").join(slim.alias("s"), same_key(nk, "b", "s"), "left").select("b.*", kind.alias("_class"))
    out = close_versions(current, c.filter("_class = 'version'"), nk, as_of)
    upd = c.filter("_class = 'overwrite'").select(*nk, *overwrite, "checksum")
    hit = F.col("u.checksum").isNotNull() & F.col("t.is_current")
    swap = {x: F.when(hit, F.col(f"u.{x}")).otherwise(F.col(f"t.{x}")) for x in (*overwrite, "checksum")}
    out = out.alias("t").join(upd.alias("u"), same_key(nk, "t", "u"), "left").select(*(swap.get(x, F.col(f"t.{x}")).alias(x) for x in current.columns))
    return out.unionByName(_opened(c.filter("_class IN ('new', 'version')"), as_of, current))


def metadata_bag(batch: DataFrame, nk: list[str], tracked: list[str]) -> DataFrame:
    """Key columns, metadata (JSON of the tracked columns, nulls kept) and row_hash; rows with a null key go."""
    js = F.to_json(F.struct(*tracked), {"ignoreNullFields": "false"})
    out = batch.select(*nk, js.alias("metadata"), row_hash(tracked).alias("row_hash"))
    for c in nk:
        out = out.filter(F.col(c).isNotNull())
    return out


def scd_metadata(current: DataFrame, batch: DataFrame, nk: list[str], tracked: list[str], as_of: str) -> DataFrame:
    """SCD2 over a JSON bag; metadata_diff of a new version is the bag before."""
    bag = metadata_bag(batch, nk, tracked)
    cur = current.filter("is_current").select(*nk, F.col("row_hash").alias("_old"), F.col("metadata").alias("_bag"))
    c = bag.alias("b").join(cur.alias("s"), same_key(nk, "b", "s"), "left").filter("s._old IS NULL OR s._old <> b.row_hash").select("b.*", F.col("s._bag").alias("metadata_diff"))
    out = close_versions(current, c.filter("metadata_diff IS NOT NULL"), nk, as_of)
    return out.unionByName(_opened(c, as_of, current))


def changed_columns(a: DataFrame, b: DataFrame, nk: list[str], tracked: list[str]) -> DataFrame:
    """Key and changes: map of each column that differs to (old, new) text."""
    j = a.alias("a").join(b.alias("b"), same_key(nk, "a", "b"))
    diffs = F.filter(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a.{c}").cast("string").alias("old"), F.col(f"b.{c}").cast("string").alias("new")) for c in tracked)), lambda d: ~d["old"].eqNullSafe(d["new"]))
    return j.select(*(F.col(f"a.{c}").alias(c) for c in nk), diffs.alias("changes")).filter(F.size("changes") > 0)


def backfill(snapshots: DataFrame, nk: list[str], tracked: list[str], order: str) -> DataFrame:
    """SCD2 versions from periodic snapshots: one row for each streak of equal values; the last is current."""
    w = W.partitionBy(*nk).orderBy(order)
    changed = F.lit(False)
    for c in tracked:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = snapshots.withColumn("_new", F.when(changed | (F.row_number().over(w) == 1), 1).otherwise(0)).withColumn("_streak", F.sum("_new").over(w))
    out = marked.groupBy(*nk, "_streak").agg(*(F.max_by(c, order).alias(c) for c in tracked), F.min(order).alias("valid_from"), F.max(order).alias("last_seen"))
    last = F.lead("valid_from").over(W.partitionBy(*nk).orderBy("_streak"))
    return out.withColumn("valid_to", last).withColumn("is_current", last.isNull()).drop("_streak")


def cumulative_backfill(rows: DataFrame, nk: list[str], order: str, fields: list[str], name: str = "history") -> DataFrame:
    """One row a key with the history as an array of structs in order."""
    return rows.groupBy(*nk).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))


def initialised(rows: DataFrame, as_of: str) -> DataFrame:
    """SCD2 columns for rows that lack values: current since ``as_of``."""
    have = set(rows.columns)
    old = lambda c, v, t: F.coalesce(F.col(c), v) if c in have else v.cast(t)
    return rows.withColumns({"valid_from": old("valid_from", F.lit(as_of).cast("timestamp_ntz"), "timestamp_ntz"), "valid_to": F.col("valid_to") if "valid_to" in have else F.lit(None).cast("timestamp_ntz"), "is_current": old("is_current", F.lit(True), "boolean")})


def history_dropped(rows: DataFrame) -> DataFrame:
    return rows.filter("is_current").drop("valid_from", "valid_to", "is_current", "checksum")


def audit_log(before: DataFrame, after: DataFrame, nk: list[str], tracked: list[str]) -> DataFrame:
    """Key, action (insert, update or delete) and changes between two states' current rows."""
    a, b = before.filter("is_current"), after.filter("is_current")
    upd = changed_columns(a, b, nk, tracked).select(*nk, F.lit("update").alias("action"), F.to_json("changes").alias("changes"))
    one = lambda x, y, action: x.select(*nk).alias("x").join(y.alias("y"), same_key(nk, "x", "y"), "left_anti").select(*nk, F.lit(action).alias("action"), F.lit(None).cast("string").alias("changes"))
    return upd.unionByName(one(b, a, "insert")).unionByName(one(a, b, "delete"))
