"""Industry frameworks: authored text (or YAML of the same shape) to resolved specs and broadcast tables.

A framework is small and written by hand, so it is resolved on the driver while a plan is being built; everything
it then describes runs as DataFrame operations. `overlay` is the same inheritance rule as a DataFrame operator for
spec tables that live in storage.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.formula import formula
from ..session import spec_frame
from . import specdata

OPENING = "__opening"


class SpecError(ValueError):
    """A framework contradicts itself or its parent."""


@dataclass(frozen=True)
class Metric:
    id: str
    name: str
    unit_kind: str
    statement: str
    period_type: str
    sign: str = "any"
    concepts: tuple[str, ...] = ()
    derivation: str | None = None
    additive: bool | None = None
    labels: tuple[str, ...] = ()
    column: str | None = None
    tag_names: tuple[str, ...] = ()
    dimensions: tuple[tuple[str, str], ...] = ()

    @property
    def is_additive(self) -> bool:
        default = self.unit_kind == "currency" and self.period_type == "duration"
        return default if self.additive is None else self.additive

    @property
    def document_only(self) -> bool:
        return not self.concepts and not self.derivation


@dataclass(frozen=True)
class Check:
    id: str
    left: str
    right: str
    optional: tuple[str, ...] = ()
    severity: str = "error"

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(sorted({*formula(self.left).names, *formula(self.right).names}))


@dataclass(frozen=True)
class Analytic:
    id: str
    name: str
    category: str
    kind: str
    unit_kind: str
    metric: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    basis: str = "period_end"
    formula: str | None = None
    of: str | None = None
    relative_to: str | None = None

    @property
    def references(self) -> frozenset[str]:
        plain = {n for n in (self.metric, self.of, self.relative_to) if n}
        for text in (self.numerator, self.denominator, self.formula):
            plain |= set(formula(text).names) if text else set()
        return frozenset(plain)


@dataclass(frozen=True)
class Chart:
    id: str
    title: str
    kind: str
    series: tuple[str, ...]
    format: str


@dataclass(frozen=True)
class Driver:
    id: str
    name: str
    affects: tuple[str, ...]
    formula: str | None = None
    fallback: str | None = None


@dataclass(frozen=True)
class Framework:
    name: str
    label: str
    extends: str | None = None
    metrics: dict[str, Metric] = field(default_factory=dict)
    checks: dict[str, Check] = field(default_factory=dict)
    analytics: dict[str, Analytic] = field(default_factory=dict)
    charts: dict[str, Chart] = field(default_factory=dict)
    drivers: dict[str, Driver] = field(default_factory=dict)
    targets: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    excluded: dict[str, str] = field(default_factory=dict)
    sections: tuple[str, ...] = ()
    sic: tuple[tuple[int, int], ...] = ()
    removed: dict[str, tuple[str, ...]] = field(default_factory=dict)


KINDS = ("metrics", "checks", "analytics", "charts", "drivers")


def from_yaml(path: str | Path) -> Framework:
    """A user's framework file (metrics, checks, analytics, charts, drivers, targets, valuation as mappings)."""
    try:
        import yaml
    except ImportError as missing:  # pragma: no cover - depends on the installation
        raise RuntimeError("reading a YAML framework needs PyYAML") from missing
    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or raw.get("name") != Path(path).stem:
        raise SpecError(f"{path}: expected a mapping whose name matches the file name")
    return from_mapping(raw)


def from_mapping(raw: dict) -> Framework:
    """A framework file, or a shipped framework (see specdata), as specs."""

    def metric(m: dict) -> Metric:
        hint = m.get("document") or {}
        return Metric(
            m["id"], m["name"], m["unit_kind"], m["statement"], m["period_type"], m.get("expected_sign", "any"),
            tuple(m.get("xbrl_concepts", ())), m.get("derivation"), m.get("additive"), tuple(hint.get("labels", ())),
            hint.get("column"), tuple(hint.get("concepts", ())), tuple(hint.get("dimensions", {}).items()),
        )

    def analytic(a: dict) -> Analytic:
        rest = {k: a[k] for k in ("metric", "numerator", "denominator", "formula", "of", "relative_to") if k in a}
        return Analytic(a["id"], a["name"], a["category"], a["kind"], a["unit_kind"], basis=a.get("denominator_basis", "period_end"), **rest)

    valuation = raw.get("valuation") or {}
    flat = {
        "name": raw["name"], "label": raw["display_name"], "extends": raw.get("extends"),
        "targets": " ".join(raw.get("forecast_targets", ())), "preferred": " ".join(valuation.get("preferred", ())),
        "excluded": valuation.get("excluded", {}), "sections": " ".join(raw.get("report_sections", ())),
    }
    removed = {k: " ".join(raw.get(f"remove_{k}", ())) for k in KINDS}
    removed["targets"] = " ".join(raw.get("remove_forecast_targets", ()))
    return _assemble(
        flat,
        [metric(m) for m in raw.get("metrics", ())],
        [Check(c["id"], c["left"], c["right"], tuple(c.get("optional_terms", ())), c.get("severity", "error")) for c in raw.get("checks", ())],
        [analytic(a) for a in raw.get("analytics", ())],
        [Chart(c["id"], c["title"], c["kind"], tuple(c["series"]), c["format"]) for c in raw.get("charts", ())],
        [Driver(d["id"], d["name"], tuple(d["affects"]), d.get("formula"), d.get("fallback")) for d in raw.get("drivers", ())],
        [tuple(r) for r in (raw.get("classification") or {}).get("sic_ranges", ())],
        removed,
    )


def _assemble(raw, metrics, checks, analytics, charts, drivers, sic, removed) -> Framework:
    for kind, items in zip(KINDS, (metrics, checks, analytics, charts, drivers), strict=True):
        ids = [item.id for item in items]
        repeated = sorted({i for i in ids if ids.count(i) > 1})
        if repeated:
            raise SpecError(f"{raw['name']}: duplicate ids in {kind}: {repeated}")
    keyed = [{item.id: item for item in items} for items in (metrics, checks, analytics, charts, drivers)]
    return Framework(
        raw["name"], raw["label"], raw.get("extends"), *keyed, tuple(raw.get("targets", "").split()),
        tuple(raw.get("preferred", "").split()), dict(raw.get("excluded", {})), tuple(raw.get("sections", "").split()),
        tuple(tuple(r) for r in sic), {k: tuple(v.split()) for k, v in removed.items() if v},
    )


def extend(parent: Framework, child: Framework) -> Framework:
    """Parent minus removals, overridden and extended by the child."""
    changed = {}
    for kind in (*KINDS, "targets"):
        gone, inherited = set(child.removed.get(kind, ())), getattr(parent, kind)
        unknown = sorted(gone - set(inherited))
        if unknown:
            raise SpecError(f"{child.name}: cannot remove {kind} the parent does not define: {unknown}")
        if kind == "targets":
            changed[kind] = tuple(dict.fromkeys([t for t in inherited if t not in gone] + list(child.targets)))
        else:
            changed[kind] = {k: v for k, v in inherited.items() if k not in gone} | getattr(child, kind)
    kept = {m: why for m, why in parent.excluded.items() if m not in child.preferred}
    preferred = child.preferred or tuple(m for m in parent.preferred if m not in child.excluded)
    return replace(child, **changed, preferred=preferred, excluded=kept | child.excluded, sections=child.sections or parent.sections)


def resolve(frameworks: Iterable[Framework]) -> dict[str, Framework]:
    raw = {f.name: f for f in frameworks}
    done: dict[str, Framework] = {}

    def get(name: str, above: tuple[str, ...]) -> Framework:
        if name in above:
            raise SpecError(f"frameworks extend each other: {' -> '.join((*above, name))}")
        if name not in raw:
            raise SpecError(f"unknown framework {name!r}")
        if name not in done:
            own = raw[name]
            if own.extends is None and own.removed:
                raise SpecError(f"{name}: a root framework inherits nothing to remove")
            done[name] = own if own.extends is None else extend(get(own.extends, (*above, name)), own)
        return done[name]

    for name in raw:
        get(name, ())
    return done


def shipped() -> dict[str, Framework]:
    return resolve(map(from_mapping, specdata.SHIPPED))


def load(directory: str | Path) -> dict[str, Framework]:
    files = sorted(Path(directory).glob("*.yaml"))
    if not files:
        raise SpecError(f"no framework files in {directory}")
    return resolve(from_yaml(f) for f in files)


def ordered_layers(items: dict[str, frozenset[str] | set[str] | tuple[str, ...]]) -> list[list[str]]:
    """Names grouped so that every name only depends on earlier groups; one plan layer is built per group."""
    left, layers, placed = dict(items), [], set()
    while left:
        ready = [name for name, needs in left.items() if not (set(needs) & set(items)) - placed]
        if not ready:
            raise SpecError(f"circular definition among {sorted(left)}")
        layers.append(ready)
        placed |= set(ready)
        left = {name: needs for name, needs in left.items() if name not in placed}
    return layers


# ---- spec tables ------------------------------------------------------------------------------------------------

_S, _I, _B = pa.string(), pa.int32(), pa.bool_()


def metric_spec(spark: SparkSession, frameworks: dict[str, Framework]) -> DataFrame:
    rows = [
        {"framework": f.name, "metric_id": m.id, "name": m.name, "unit_kind": m.unit_kind, "statement": m.statement,
         "period_type": m.period_type, "derivation": m.derivation, "sign": m.sign, "additive": m.is_additive,
         "has_concepts": bool(m.concepts), "position": i}
        for f in frameworks.values() for i, m in enumerate(f.metrics.values())
    ]
    schema = pa.schema([("framework", _S), ("metric_id", _S), ("name", _S), ("unit_kind", _S), ("statement", _S),
                        ("period_type", _S), ("derivation", _S), ("sign", _S), ("additive", _B), ("has_concepts", _B), ("position", _I)])
    return spec_frame(spark, rows, schema)


def concept_targets(spark: SparkSession, frameworks: dict[str, Framework]) -> DataFrame:
    """One row per (framework, tag) with the array of metrics it can feed, so that joining it never fans out."""
    found: dict[tuple[str, str], list[dict]] = {}
    for f in frameworks.values():
        for m in f.metrics.values():
            for rank, concept in enumerate(m.concepts):
                found.setdefault((f.name, concept), []).append(
                    {"metric_id": m.id, "rank": rank, "ranks": len(m.concepts), "unit_kind": m.unit_kind, "metric_period_type": m.period_type}
                )
    target = pa.struct([("metric_id", _S), ("rank", _I), ("ranks", _I), ("unit_kind", _S), ("metric_period_type", _S)])
    rows = [{"framework": f, "qname": q, "targets": t} for (f, q), t in found.items()]
    return spec_frame(spark, rows, pa.schema([("framework", _S), ("qname", _S), ("targets", pa.list_(target))]))


def analytic_spec(spark: SparkSession, frameworks: dict[str, Framework]) -> DataFrame:
    rows = [
        {"framework": f.name, "analytic_id": a.id, "name": a.name, "category": a.category, "kind": a.kind,
         "unit_kind": a.unit_kind, "metric": a.metric, "basis": a.basis, "position": i}
        for f in frameworks.values() for i, a in enumerate(f.analytics.values())
    ]
    schema = pa.schema([("framework", _S), ("analytic_id", _S), ("name", _S), ("category", _S), ("kind", _S),
                        ("unit_kind", _S), ("metric", _S), ("basis", _S), ("position", _I)])
    return spec_frame(spark, rows, schema)


def reference_table(spark: SparkSession, frameworks: dict[str, Framework]) -> DataFrame:
    """(framework, owner kind, owner, referenced name, where) for every name a spec mentions."""
    rows = []
    for f in frameworks.values():
        def add(kind, owner, where, names):
            rows.extend({"framework": f.name, "kind": kind, "owner": owner, "place": where, "name": n} for n in names)
        for m in f.metrics.values():
            add("metric", m.id, "derivation", formula(m.derivation).names if m.derivation else ())
        for a in f.analytics.values():
            add("analytic", a.id, "analytic", sorted(a.references))
            if a.kind == "ratio":
                add("analytic", a.id, "denominator", formula(a.denominator).names)
        for d in f.drivers.values():
            add("driver", d.id, "affects", d.affects)
            add("driver", d.id, "driver_formula", formula(d.formula).names if d.formula else ())
        for c in f.checks.values():
            add("check", c.id, "check", c.names)
        for c in f.charts.values():
            add("chart", c.id, "chart", c.series)
        add("framework", f.name, "target", f.targets)
    schema = pa.schema([("framework", _S), ("kind", _S), ("owner", _S), ("place", _S), ("name", _S)])
    return spec_frame(spark, rows, schema)


def spec_violations(spark: SparkSession, frameworks: dict[str, Framework]) -> DataFrame:
    """Rows (framework, rule, owner, name) for every broken cross-reference; empty when all frameworks are sound."""
    metrics = metric_spec(spark, frameworks).select("framework", F.col("metric_id").alias("name"), "period_type")
    analytics = analytic_spec(spark, frameworks)
    analytic_ids = analytics.select("framework", F.col("analytic_id").alias("name"))
    series = metrics.select("framework", "name").unionByName(analytic_ids)
    refs = reference_table(spark, frameworks).withColumn("base", F.regexp_replace("name", f"{OPENING}$", ""))

    def report(df: DataFrame, rule: str) -> DataFrame:
        return df.select("framework", F.lit(rule).alias("rule"), "owner", "name")

    metric_places = refs.filter(F.col("place").isin("derivation", "affects", "target", "check"))
    unknown_metric = metric_places.join(
        metrics.select("framework", F.col("name").alias("base")), ["framework", "base"], "left_anti"
    )
    series_places = refs.filter(F.col("place").isin("analytic", "driver_formula", "chart"))
    unknown_series = series_places.join(series, ["framework", "name"], "left_anti")
    owner_type = metrics.select("framework", F.col("name").alias("owner"), F.col("period_type").alias("owner_type"))
    mixed = (
        refs.filter("place = 'derivation'").join(metrics, ["framework", "name"]).join(owner_type, ["framework", "owner"])
        .filter("period_type <> owner_type")
    )
    opening_flow = refs.filter("place = 'check' AND name <> base").join(
        metrics.withColumnRenamed("name", "base"), ["framework", "base"]
    ).filter("period_type <> 'instant'")
    based = analytics.filter("kind = 'ratio' AND basis <> 'period_end'").select("framework", F.col("analytic_id").alias("owner"))
    with_balance = refs.filter("place = 'denominator'").join(metrics.filter("period_type = 'instant'"), ["framework", "name"])
    no_balance = based.join(with_balance.select("framework", "owner"), ["framework", "owner"], "left_anti").withColumn("name", F.col("owner"))
    clash = analytic_ids.join(metrics, ["framework", "name"], "left_semi").withColumn("owner", F.col("name"))
    return (
        report(unknown_metric, "unknown_metric")
        .unionByName(report(unknown_series, "unknown_series"))
        .unionByName(report(mixed, "mixed_period_types"))
        .unionByName(report(opening_flow, "opening_of_a_flow"))
        .unionByName(report(no_balance, "basis_without_balance"))
        .unionByName(report(clash, "id_used_twice"))
    )


def overlay(items: DataFrame, removals: DataFrame, depth: str = "depth", key: str = "item_id") -> DataFrame:
    """Inheritance over stored spec rows: deepest definition of an id wins unless a deeper level removed it.

    items: (group, depth, id, ...) with 0 the root. removals: (group, depth, id), depth = the level that removes.
    """
    cut = removals.groupBy("group_id", key).agg(F.max(depth).alias("removed_at"))
    alive = items.join(cut, ["group_id", key], "left").filter(F.col("removed_at").isNull() | (F.col(depth) >= F.col("removed_at")))
    deepest = Window.partitionBy("group_id", key).orderBy(F.col(depth).desc())
    return alive.withColumn("_n", F.row_number().over(deepest)).filter("_n = 1").drop("_n", "removed_at")


def overlay_violations(items: DataFrame, removals: DataFrame, depth: str = "depth", key: str = "item_id") -> DataFrame:
    """Removals of something no shallower level defines."""
    defined = items.select("group_id", key, F.col(depth).alias("defined_at"))
    return removals.join(
        defined, (removals.group_id == defined.group_id) & (removals[key] == defined[key]) & (defined.defined_at < removals[depth]), "left_anti"
    )


def valuation_methods(spark: SparkSession, frameworks: dict[str, Framework], families: tuple[str, ...]) -> DataFrame:
    """Preferred valuation methods of each framework inside the chosen families, in order, and what it excludes."""
    family_of = {m: fam for fam, methods in specdata.METHOD_FAMILIES.items() for m in methods}
    rows = [
        {"framework": f.name, "method": m, "family": family_of[m], "position": i, "excluded_reason": None}
        for f in frameworks.values() for i, m in enumerate(f.preferred)
    ] + [
        {"framework": f.name, "method": m, "family": family_of[m], "position": None, "excluded_reason": why}
        for f in frameworks.values() for m, why in f.excluded.items()
    ]
    schema = pa.schema([("framework", _S), ("method", _S), ("family", _S), ("position", _I), ("excluded_reason", _S)])
    table = spec_frame(spark, rows, schema)
    return table.filter(F.col("family").isin(*families)).orderBy("framework", F.col("position").asc_nulls_last())
