"""The nine measures of every variant over sub-cohorts: one plan for all query shapes.

calls ─ broadcast samples ─ aggregate per (variant, technology)      one scan and one shuffle of facts, combined map-side
      ─ broadcast capture stretches: which kits cover the position   at most one stretch a row
      ─ aggregate per variant                                        a shuffle of a few rows per variant

How many males and females each technology has in a sub-cohort is known to the driver (one number per technology and
group), so neither the samples nor kits without carriers need rows of their own: what kits without carriers add to
N_NO_COVERAGE follows from the stretch, and kits with carriers correct it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from varicohort.functions.ploidy import allele_number, ploidy
from varicohort.operators.coverage import with_segment
from varicohort.operators.filters import SampleFilter, sample_attributes
from varicohort.plans.cohort import VARIANT, Cohort
from varicohort.session import can_broadcast, local_table

MEASURES = ["AC", "AN", "AF", "n_eligible", "N_HET", "N_HOM_ALT", "N_HOM_REF", "N_FAIL", "N_NO_COVERAGE"]
COUNTS = ["AC", "N_HET", "N_HOM_ALT", "N_FAIL", "pass", "obs", "qp"]
LOCAL_BYTES = 4 << 20
WHOLE = -1  # number of the group that holds every sample


def _small(df: DataFrame, basis: DataFrame) -> DataFrame:
    """Broadcast ``df``, which has at most one short row for each of ``basis``, if that is known to be small."""
    return F.broadcast(df) if can_broadcast(basis) else df


def flagged_samples(cohort: Cohort, filters: list[SampleFilter]) -> DataFrame:
    """sample_id, sex, tech_id, inside (member of the first filter), groups (numbers of all filters it belongs to)."""
    key = ("flagged", *filters)
    if key not in cohort.memo:
        flagged = _flagged_samples(cohort, filters)
        cohort.memo[key] = local_table(flagged) if cohort.memo.get("local") else flagged
    return cohort.memo[key]


def _attributes(cohort: Cohort) -> DataFrame:
    """Attributes of the samples; those of a stored cohort are fetched once, if they are known to be small."""
    if "attributes" not in cohort.memo:
        s = sample_attributes(cohort.samples, cohort.sample_phenotype, cohort.technologies).select("sample_id", "sex", "tech_id", "tech_name", "codes")
        small = cohort.partitioned and all(can_broadcast(t, LOCAL_BYTES) for t in (cohort.samples, cohort.sample_phenotype))
        cohort.memo["attributes"], cohort.memo["local"] = local_table(s) if small else s, small
    return cohort.memo["attributes"]


def _flagged_samples(cohort: Cohort, filters: list[SampleFilter]) -> DataFrame:
    s = _attributes(cohort)
    member = [f.member(F.col("codes"), F.col("tech_name"), F.col("sex")) for f in filters]
    numbers = F.filter(F.array(*(F.when(m, F.lit(i)) for i, m in enumerate(member))), lambda x: x.isNotNull())
    return s.select("sample_id", "sex", "tech_id", member[0].alias("inside"), numbers.alias("groups"))


class Headcount:
    """Males and females of every technology in every group: technologies times groups numbers, as SQL literals."""

    def __init__(self, cohort: Cohort, filters: list[SampleFilter], flagged: DataFrame):
        self.n = len(filters)
        rows = flagged.select("tech_id", "sex", F.explode("groups").alias("grp")).where("sex IN ('male', 'female')").groupBy("tech_id", "sex", "grp").count().collect()
        if "always" not in cohort.memo:
            cohort.memo["always"] = sorted(r[0] for r in cohort.technologies.where("always_covered").select("tech_id").collect() if r[0] is not None)
        self.always = cohort.memo["always"]
        self.per: dict[str, dict[int, list[int]]] = {"male": {}, "female": {}}
        for r in rows:
            if r["tech_id"] is not None:
                self.per[r["sex"]].setdefault(r["tech_id"], [0] * self.n)[r["grp"]] += r["count"]

    def _of(self, table: dict[int, list[int]], tech: str, grp: str) -> str:
        text = json.dumps({str(k): v for k, v in table.items()})
        return f"coalesce(get(try_element_at(from_json('{text}', 'map<string,array<bigint>>'), CAST({tech} AS STRING)), {grp}), 0L)"

    def samples_of(self, tech: str, grp: str) -> str:
        """Samples of a technology in a group."""
        m, f, none = self.per["male"], self.per["female"], [0] * self.n
        return self._of({t: [a + b for a, b in zip(m.get(t, none), f.get(t, none))] for t in {*m, *f}}, tech, grp)

    def everywhere(self, sex: str) -> str:
        """Array over the groups: samples of the technologies that cover every position."""
        sums = [sum(self.per[sex].get(t, [0] * self.n)[g] for t in self.always) for g in range(self.n)]
        return f"from_json('{json.dumps(sums)}', 'array<bigint>')"

    def is_always(self, tech: str) -> str:
        return f"coalesce({tech} IN ({', '.join(map(str, self.always))}), false)" if self.always else "false"

    def of_kits(self, kits: str, sex: str) -> str:
        """Array over the groups: samples of a list of kits."""
        return f"transform(sequence(0, {self.n - 1}), g -> aggregate({kits}, 0L, (a, t) -> a + {self._of(self.per[sex], 't', 'g')}))"


def headcount(cohort: Cohort, filters: list[SampleFilter], flagged: DataFrame) -> Headcount:
    key = tuple(filters)
    if key not in cohort.memo:
        cohort.memo[key] = Headcount(cohort, filters, flagged)
    return cohort.memo[key]


def with_position_facts(rows: DataFrame, cohort: Cohort, heads: Headcount, near: str = "true") -> DataFrame:
    """``rows`` with kits (that cover the position) and __males, __females, __kit_samples: arrays over the groups.

    ``near`` narrows the stretches to those that rows can lie in.
    """
    key = ("stretches", json.dumps(heads.per))
    if key not in cohort.memo:
        cohort.memo[key] = cohort.coverage().selectExpr("chrom", "start0", "end0", "kits", f"{heads.of_kits('kits', 'male')} AS __km", f"{heads.of_kits('kits', 'female')} AS __kf")
    j = with_segment(rows, cohort.memo[key].where(near), cohort.stretches if cohort.stretches is not None else cohort.capture)
    km, kf = (f"coalesce({c}, array_repeat(0L, {heads.n}))" for c in ("__km", "__kf"))
    add = lambda a, b: f"zip_with({a}, {b}, (x, y) -> x + y)"
    facts = ["coalesce(kits, CAST(array() AS ARRAY<INT>)) AS kits", f"{add(km, heads.everywhere('male'))} AS __males", f"{add(kf, heads.everywhere('female'))} AS __females", f"{add(km, kf)} AS __kit_samples"]
    return j.selectExpr(*(f"`{c}`" for c in rows.columns), *facts)


def an_of(cohort: Cohort, males: str, females: str) -> str:
    return allele_number("chrom", "pos", males, females, cohort.build)


def kit_gate(sf: SampleFilter, min_covered: int) -> tuple[bool, str]:
    """Whether any evidence gate is on, and whether a kit with counts pass, obs, qp, qp_all fails one."""
    fails = []
    if sf.min_pass > 0 or sf.min_observed > 0:
        fails.append(f"pass < {sf.min_pass} OR obs < {sf.min_observed}")
    if min_covered > 0:
        fails.append(f"qp_all < {min_covered}")
    if sf.min_quality_evidence > 0:
        fails.append(f"qp < {sf.min_quality_evidence}")
    return bool(fails), " OR ".join(fails) or "false"


def check_gates(cohort: Cohort, sf: SampleFilter) -> None:
    if sf.min_quality_evidence > 0 and not cohort.quality.active:
        raise ValueError("min_quality_evidence needs a cohort that was built with quality thresholds")


def _counts(inside: str) -> list[Column]:
    """The counts of COUNTS over the rows for which ``inside`` holds; p is the ploidy."""
    any_ = "(is_het OR is_hom)"
    texts = {
        "AC": f"coalesce(sum(CASE WHEN {inside} THEN CASE p WHEN 1 THEN int({any_}) WHEN 2 THEN int(is_het) + 2 * int(is_hom) ELSE 0 END END), 0L)",
        "N_HET": f"count_if({inside} AND is_het AND p = 2)",
        "N_HOM_ALT": f"count_if({inside} AND is_hom AND p = 2) + count_if({inside} AND {any_} AND p = 1)",
        "N_FAIL": f"count_if({inside} AND is_fail)",
        "pass": f"count_if({inside} AND {any_})",
        "obs": f"count_if({inside} AND ({any_} OR is_fail))",
        "qp": f"count_if({inside} AND is_qp)",
    }
    return [F.expr(f"{t} AS {k}") for k, t in texts.items()]


def _with_samples(cohort: Cohort, calls: DataFrame, flagged: DataFrame) -> DataFrame:
    c = calls.where("is_het OR is_hom OR is_fail OR is_qp").join(_small(flagged, cohort.samples), "sample_id", "left")
    return c.withColumn("p", F.expr(ploidy("chrom", "pos", "sex", cohort.build)))


def _whole() -> list[Column]:
    """Facts over all samples, inside or not: whether the variant is stored, and quality-passing calls."""
    return [F.expr("bool_or(is_het OR is_hom OR is_fail) AS has_class"), F.expr("count_if(is_qp AND sex IS NOT NULL) AS qp_all")]


def per_technology(cohort: Cohort, calls: DataFrame, flagged: DataFrame) -> DataFrame:
    """VARIANT, tech_id, COUNTS of the first group, has_class and qp_all; calls of unknown samples have a null tech_id."""
    return _with_samples(cohort, calls, flagged).groupBy(*VARIANT, "tech_id").agg(*_whole(), *_counts("inside"))


def _per_variant(cohort: Cohort, tech: DataFrame, heads: Headcount, sf: SampleFilter, by: list[str], grp: str) -> DataFrame:
    """Sum the technologies of a variant (and group): the counts, and spared, by which kits with carriers lower N_NO_COVERAGE."""
    _, fails = kit_gate(sf, cohort.quality.min_covered)
    always, size = heads.is_always("tech_id"), heads.samples_of("tech_id", grp)
    # a kit without carriers fails every gate that is on: all its samples count, unless its carriers' row says less
    spared = f"CASE WHEN __covered AND NOT {always} THEN {size} - CASE WHEN {fails} THEN {size} - obs ELSE 0L END ELSE 0L END"
    flat = tech.selectExpr("*", f"coalesce({always} OR array_contains(kits, int(tech_id)), false) AS __covered").selectExpr("*", f"{spared} AS __spared")
    sums = [f"sum(CASE WHEN __covered THEN {c} ELSE 0L END) AS {c}" for c in ("AC", "N_HET", "N_HOM_ALT", "N_FAIL")]
    firsts = [f"first({c}) AS {c}" for c in ("__males", "__females", "__kit_samples")]
    return flat.groupBy(*by).agg(*map(F.expr, ["bool_or(has_class) AS has_class", *sums, "sum(__spared) AS spared", *firsts]))


def _finish(cohort: Cohort, on: bool, count, males: str, females: str, kit_samples: str) -> dict[str, str]:
    """MEASURES from counts and headcounts as SQL; ``count`` gives the text of a count by name."""
    an, n = an_of(cohort, males, females), f"({males} + {females})"
    no = f"({kit_samples} - {count('spared')})" if on else "0L"
    rest = " - ".join([n, count("N_HET"), count("N_HOM_ALT"), count("N_FAIL"), no])
    return {"AC": count("AC"), "AN": an, "AF": f"try_divide({count('AC')}, {an})", "n_eligible": n, "N_HET": count("N_HET"), "N_HOM_ALT": count("N_HOM_ALT"), "N_HOM_REF": rest, "N_FAIL": count("N_FAIL"), "N_NO_COVERAGE": no}


def measures(cohort: Cohort, sf: SampleFilter, calls: DataFrame | None = None, near: str = "true") -> DataFrame:
    """VARIANT and MEASURES for every stored variant of ``calls`` (default: all) whose AN over the sub-cohort is not 0.

    ``near`` is a condition on capture stretches that all positions of ``calls`` keep; it only saves work.

    Variants that no sample of the sub-cohort carries are there with AC 0, also those whose carriers have left the
    cohort (until it is compacted). An empty sub-cohort gives no rows.
    """
    check_gates(cohort, sf)
    flagged = flagged_samples(cohort, [sf])
    heads = headcount(cohort, [sf], flagged)
    tech = with_position_facts(per_technology(cohort, cohort.calls if calls is None else calls, flagged), cohort, heads, near)
    tech = tech.selectExpr(*(c for c in tech.columns if not c.startswith("__")), *(f"{c}[0] AS {c}" for c in ("__males", "__females", "__kit_samples")))
    v = _per_variant(cohort, tech, heads, sf, VARIANT, "0").where("has_class")
    on, _ = kit_gate(sf, cohort.quality.min_covered)
    m = _finish(cohort, on, str, "__males", "__females", "__kit_samples")
    return v.selectExpr(*VARIANT, *(f"{c} AS {k}" for k, c in m.items())).where("AN > 0")


def measures_by_group(cohort: Cohort, filters: list[SampleFilter], calls: DataFrame | None = None) -> DataFrame:
    """VARIANT and ``g``, an array with a struct of MEASURES for each filter, for every stored variant.

    AN may be 0 there, with AF null. The evidence gates are those of the first filter. The calls are read and shuffled
    once: a call takes part in every group of its sample, and in the group of all samples.
    """
    sf, n = filters[0], len(filters)
    check_gates(cohort, sf)
    flagged = flagged_samples(cohort, filters)
    heads = headcount(cohort, filters, flagged)
    c = _with_samples(cohort, cohort.calls if calls is None else calls, flagged)
    c = c.withColumn("grp", F.explode(F.concat(F.coalesce("groups", F.array().cast("array<int>")), F.array(F.lit(WHOLE)))))
    tech = c.groupBy(*VARIANT, "tech_id", "grp").agg(*_whole(), *_counts("true"))
    if cohort.quality.min_covered > 0:  # the build gate looks at the whole cohort: a number that the other groups need too
        from pyspark.sql import Window

        tech = tech.withColumn("qp_all", F.max(F.when(F.col("grp") == WHOLE, F.col("qp_all"))).over(Window.partitionBy(*VARIANT, "tech_id")))
    tech = with_position_facts(tech, cohort, heads)
    per = _per_variant(cohort, tech, heads, sf, [*VARIANT, "grp"], "grp")
    names = ["AC", "N_HET", "N_HOM_ALT", "N_FAIL", "spared"]
    v = per.groupBy(*VARIANT).agg(F.bool_or("has_class").alias("has_class"), F.map_from_entries(F.collect_list(F.struct("grp", F.struct(*names)))).alias("c"), *(F.first(x).alias(x) for x in ("__males", "__females", "__kit_samples"))).where("has_class")
    on, _ = kit_gate(sf, cohort.quality.min_covered)
    m = _finish(cohort, on, lambda k: f"coalesce(try_element_at(c, i).{k}, 0L)", "get(__males, i)", "get(__females, i)", "get(__kit_samples, i)")
    return v.selectExpr(*VARIANT, f"transform(sequence(0, {n - 1}), i -> named_struct({', '.join(f"'{k}', {x}" for k, x in m.items())})) AS g")
