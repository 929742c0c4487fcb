"""Roll-ups and set-level checks: families and layers of an inventory, ordered groups and their digests, ledgers, bundles, archives, coverage, overall results."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder
from ledgerloom.operators.evidence import examples


def family_summaries(members: DataFrame, policy: DataFrame, family: str, layer: str, shape: str, kind: str) -> DataFrame:
    """(family, n, missing, duplicate, unexpected, shape_ok, type_ok) of every family of ``policy`` (family, layers, shape, kinds), also of those without members, whose shape and type are not valid."""
    own = members.groupBy(family, layer).agg(F.count("*").alias("n"), F.collect_set(shape).alias("shapes"), F.collect_set(kind).alias("kinds"))
    sums = own.groupBy(family).agg(
        F.sum("n").alias("n"), F.collect_set(layer).alias("held"), F.collect_set(F.when(F.col("n") > 1, F.col(layer))).alias("twice"), F.array_distinct(F.flatten(F.collect_list("shapes"))).alias("own_shapes"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("own_kinds"),
    )
    none = F.array().cast("array<int>")
    both = policy.join(sums, family, "left").withColumn("held", F.coalesce("held", none)).withColumn("twice", F.coalesce("twice", none))
    said = lambda x: F.array_join(F.array_sort(x).cast("array<string>"), ",")
    shape_ok = F.coalesce((F.size("own_shapes") == 1) & (F.element_at("own_shapes", 1) == F.col("shape")), F.lit(False))
    type_ok = F.coalesce(F.size(F.array_except("own_kinds", "kinds")) == 0, F.lit(False))
    return both.select(family, F.coalesce("n", F.lit(0)).alias("n"), said(F.array_except("layers", "held")).alias("missing"), said(F.col("twice")).alias("duplicate"), said(F.array_except("held", "layers")).alias("unexpected"), shape_ok.alias("shape_ok"), type_ok.alias("type_ok"))


def breakdown(members: DataFrame, family: str, shape: str, kind: str, name: str, cap: int) -> DataFrame:
    """(family, n, shapes, kinds, examples): counts of shapes and kinds as ordered texts, with the smallest names."""
    counted = lambda c, as_: members.groupBy(family, c).agg(F.count("*").alias("n")).groupBy(family).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(c).cast("string"), "n"))), ",").alias(as_))
    return examples(members, family, name, cap).join(counted(shape, "shapes"), family).join(counted(kind, "kinds"), family).select(family, "n", "shapes", "kinds", "examples")


def counts_over(values: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """(value, n) for each value of a whole domain, zeros included; other values are not counted."""
    present = values.where(F.col(column).isin(*domain)).groupBy(F.col(column).alias("held")).agg(F.count("*").alias("n"))
    every = values.sparkSession.createDataFrame([(v,) for v in domain], "value string")
    return every.join(present, F.col("value") == F.col("held"), "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def set_digests(members: DataFrame, scope: str, order: str, *fields: str) -> DataFrame:
    """(scope, n, digest) of each scope's members: each is hashed, the digests are put in the order of ``order`` and hashed together, so that a member takes 64 characters at most. Nulls are marked."""
    framed = [F.when(F.col(c).isNull(), "-;").otherwise(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"), F.lit(";"))) for c in fields]
    own = members.select(scope, F.col(order).alias("at"), F.sha2(F.concat(*framed), 256).alias("d"))
    return own.groupBy(scope).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))


def appendable(ledger: DataFrame, entries: DataFrame, chain: str, sequence: str, claim: str, digest: str, previous: str) -> DataFrame:
    """(chain, claim, status) of new entries (chain, claim, previous) against the ledger: DUPLICATE_CLAIM, WRONG_PREDECESSOR if it does not follow the chain's last digest, or APPENDABLE. A chain without entries begins with a null predecessor."""
    last = ledger.groupBy(chain).agg(F.max_by(digest, sequence).alias("last"))
    known = ledger.select(chain, claim).distinct().withColumn("known", F.lit(True))
    both = entries.join(last, chain, "left").join(known, [chain, claim], "left")
    return both.select(chain, claim, ladder([("DUPLICATE_CLAIM", F.coalesce("known", F.lit(False))), ("WRONG_PREDECESSOR", ~F.col(previous).eqNullSafe(F.col("last")))], "APPENDABLE").alias("status"))


def ledger_summaries(events: DataFrame, chain: str, sequence: str, kind: str, authenticity: str, digest: str) -> DataFrame:
    """(chain, n, first_digest, last_digest, contiguous, kinds, authenticities): a ledger's own summary, to be rebuilt and compared."""
    own = events.groupBy(chain).agg(
        F.count("*").alias("n"), F.min_by(digest, sequence).alias("first_digest"), F.max_by(digest, sequence).alias("last_digest"), (F.max(sequence) - F.min(sequence) + 1 == F.countDistinct(sequence)).alias("contiguous"),
        F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"),
    )
    classes = events.groupBy(chain, authenticity).agg(F.count("*").alias("c")).groupBy(chain).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", authenticity, "c"))), ",").alias("authenticities"))
    return own.join(classes, chain)


def supersessions(edges: DataFrame, old: str, new: str) -> DataFrame:
    """(old, n, status) of what was superseded: AMBIGUOUS by several, SELF by itself, else SUPERSEDED; rings are what ``unplaceable`` finds in the same edges."""
    sums = edges.groupBy(old).agg(F.countDistinct(new).alias("n"), F.bool_or(F.col(old) == F.col(new)).alias("own"))
    return sums.select(old, "n", ladder([("SELF", F.col("own")), ("AMBIGUOUS", F.col("n") > 1)], "SUPERSEDED").alias("status"))


def archive_findings(manifests: DataFrame, key: str, text: str, most_entries: int) -> DataFrame:
    """(key, entry, finding) of archive manifests in JSON, ``entries`` of (path, type, link): traversal, absolute paths and symbolic links, and the limit or malformation of a manifest itself (with a null entry)."""
    kind = "struct<entries: array<struct<path: string, type: string, link: string>>>"
    own = manifests.select(key, F.from_json(text, kind).alias("m"))
    broken = own.where(F.col("m.entries").isNull()).select(key, F.lit(None).cast("string").alias("entry"), F.lit("MALFORMED_ARCHIVE").alias("finding"))
    large = own.where(F.size("m.entries") > most_entries).select(key, F.lit(None).cast("string").alias("entry"), F.lit("LIMIT_EXCEEDED").alias("finding"))
    entries = own.where(F.size("m.entries") <= most_entries).select(key, F.explode("m.entries").alias("e"))
    path = F.replace(F.coalesce("e.path", F.lit("")), F.lit("\\"), F.lit("/"))
    traversal = path.rlike(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:")
    found = F.array_compact(F.array(F.when(traversal, "PATH_TRAVERSAL_ENTRY"), F.when(F.col("e.type") == "symlink", "SYMLINK_ENTRY")))
    return entries.select(key, F.col("e.path").alias("entry"), F.explode(found).alias("finding")).union(broken).union(large)


def scan_coverage(items: DataFrame, subject: str) -> DataFrame:
    """(subject, n_items, n_inspected, declared, inspected, status) of items (subject, status, declared_bytes, inspected_bytes)."""
    is_ = lambda s: F.col("status") == s
    sums = items.groupBy(subject).agg(
        F.count("*").alias("n_items"), F.count_if(is_("INSPECTED")).alias("n_inspected"), F.sum("declared_bytes").cast("long").alias("declared"), F.sum("inspected_bytes").cast("long").alias("inspected"), F.bool_or(is_("FAILED")).alias("failed"), F.bool_or(is_("UNSUPPORTED")).alias("unknown"),
    )
    rungs = [
        ("FAILED", F.col("failed")), ("UNSUPPORTED", F.col("unknown") & (F.col("n_inspected") == 0)), ("COMPLETE_FOR_DECLARED_SCOPE", (F.col("n_inspected") == F.col("n_items")) & (F.col("declared") == F.col("inspected"))), ("PARTIAL", F.col("n_inspected") > 0),
    ]
    return sums.select(subject, "n_items", "n_inspected", "declared", "inspected", ladder(rungs, "INCOMPLETE").alias("status"))


def bound(links: DataFrame, evidence: DataFrame, keys: Sequence[str], key: str) -> DataFrame:
    """(key, accepted) of links: accepted where evidence agrees on all of ``keys`` and its coverage is complete."""
    good = evidence.where("complete").select(*keys).distinct().withColumn("good", F.lit(True))
    return links.join(good, list(keys), "left").select(key, F.coalesce("good", F.lit(False)).alias("accepted"))


def bindings(records: DataFrame, table: DataFrame, identities: DataFrame, key: str, now: Column) -> DataFrame:
    """(key, result) of signature records (key, binding_id, key_id) against bindings (binding_id, key_id, identity, not_before, not_after, state) and identities (identity)."""
    b = table.select(F.col("binding_id").alias("b_id"), F.col("key_id").alias("b_key"), F.col("identity").alias("b_identity"), "not_before", "not_after", "state")
    known = identities.select(F.col("identity").alias("b_identity"), F.lit(True).alias("known")).distinct()
    both = records.join(b, F.col("binding_id") == F.col("b_id"), "left").join(known, "b_identity", "left")
    rungs = [
        ("UNAVAILABLE", F.col("binding_id").isNull()), ("BROKEN", F.col("b_id").isNull() | (F.col("b_key") != F.col("key_id")) | F.col("known").isNull()), ("EXPIRED", now > F.col("not_after")), ("BROKEN", now < F.col("not_before")), ("VERIFIED", F.col("state") == "VERIFIED_BY_TRUST_BUNDLE"),
    ]
    status = F.when(F.lit(False), "").otherwise(F.col("state"))
    for name, condition in reversed(rungs):
        status = F.when(condition, name).otherwise(status)
    return both.select(key, status.alias("result"))


def bundle_references(bundle: Mapping[str, DataFrame], keys: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(table, column, n_broken) of foreign keys (table, column, other table, other column) of a bundle's tables; nulls refer to nothing."""
    out = None
    for name, column, other, target in keys:
        lost = bundle[name].where(F.col(column).isNotNull()).join(bundle[other].select(F.col(target).alias("target")).distinct(), F.col(column) == F.col("target"), "left_anti")
        own = lost.agg(F.lit(name).alias("table"), F.lit(column).alias("column"), F.count("*").alias("n_broken"))
        out = own if out is None else out.union(own)
    return out


def overall_comparison(controls: Mapping[str, Column], family_changes: Column, identity_compatible: Column) -> Column:
    """The result of a structural comparison: all controls hold, with or without changes of quantisation, or the identities allow a difference, or nothing can be compared."""
    every = F.lit(True)
    for c in controls.values():
        every = every & c
    return ladder([("EQUIVALENCE_WITH_QUANTIZATION_DIFFERENCES", every & family_changes), ("EQUIVALENCE_WITH_LIMITATIONS", every), ("DIFFERENT", identity_compatible)], "INCOMPARABLE")


def value_statuses(left: Column, right: Column, policy: Column) -> Column:
    """How two values compare under the class of their field."""
    return ladder([("EQUAL", left.eqNullSafe(right)), ("DIFFERENT_ALLOWED", policy == "ALLOWED_DIFFERENT"), ("INFORMATIONAL", policy == "INFORMATIONAL")], "DIFFERENT_UNEXPECTED")


def whole_maps(left: DataFrame, right: DataFrame, scope: str, key: str, value: str, apart: Sequence[str]) -> DataFrame:
    """(scope, equal, apart_equal): whether two maps of a scope are the same, and whether the lists of keys with the values ``apart`` are."""
    l_ = left.select(scope, key, F.col(value).alias("l"))
    r_ = right.select(scope, key, F.col(value).alias("r"))
    both = l_.join(r_, [scope, key], "full_outer")
    inside = lambda c: F.coalesce(F.col(c).isin(*apart), F.lit(False))
    same = ~(inside("l") | inside("r")) | F.col("l").eqNullSafe(F.col("r"))
    return both.groupBy(scope).agg(F.bool_and(F.col("l").eqNullSafe(F.col("r"))).alias("equal"), F.bool_and(same).alias("apart_equal"))


def latest_by_name(rows: DataFrame, scope: str, name: str, order: str) -> DataFrame:
    """The last row of each name, as a mapping that is filled in order keeps it."""
    columns = [c for c in rows.columns if c not in (scope, name)]
    return rows.groupBy(scope, name).agg(F.max_by(F.struct(*columns), order).alias("x")).select(scope, name, "x.*")


def name_family(name: Column) -> Column:
    """A name with its numbers replaced by what they count."""
    return F.regexp_replace(F.regexp_replace(name, r"\blayers\.[0-9]+\.", "layers.{layer}."), r"\bexperts\.[0-9]+\.", "experts.{expert}.")


def within_prefix(path: Column, prefix: Column) -> Column:
    return (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))


def limited(findings: DataFrame, scope: str, order: Sequence[str], most: int) -> DataFrame:
    """A report's findings: the first ``most`` of each scope in order, each with the total of its scope."""
    total = findings.groupBy(scope).agg(F.count("*").alias("total"))
    first = findings.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(*order))).where(F.col("place") <= most)
    return first.join(total, scope)


def rule_findings(parts: Sequence[tuple[str, DataFrame, Column, Column | None]]) -> DataFrame:
    """(ordinal, rule, n_failed, n_warned, status): one row a rule (name, rows, condition that fails, condition that warns), by counting the rows that meet them; a failure outranks warnings."""
    out = None
    for k, (rule, rows, fails, warns) in enumerate(parts):
        counts = rows.agg(F.count_if(fails).alias("n_failed"), F.count_if(warns if warns is not None else F.lit(False)).alias("n_warned"))
        own = counts.select(F.lit(k + 1).alias("ordinal"), F.lit(rule).alias("rule"), "n_failed", "n_warned", ladder([("FAIL", F.col("n_failed") > 0), ("WARN", F.col("n_warned") > 0)], "PASS").alias("status"))
        out = own if out is None else out.union(own)
    return out
