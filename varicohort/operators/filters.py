"""Sub-cohorts: which samples a query is about."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from varicohort.session import can_broadcast


class CohortWarning(UserWarning):
    """A query may give fewer rows than expected, or none."""


@dataclass(frozen=True)
class SampleFilter:
    """Conditions on samples, and the evidence that kits must show. Empty lists do not restrict."""

    phenotype_include: tuple[str, ...] = ()
    phenotype_exclude: tuple[str, ...] = ()
    tech_include: tuple[str, ...] = ()
    tech_exclude: tuple[str, ...] = ()
    sex: str = "both"
    min_pass: int = 0
    min_observed: int = 0
    min_quality_evidence: int = 0

    @classmethod
    def parse(cls, phenotype: list[str] | None = None, sex: str = "both", tech: list[str] | None = None, min_pass: int = 0, min_observed: int = 0, min_quality_evidence: int = 0) -> "SampleFilter":
        """Tokens may hold commas; a leading ``^`` excludes."""
        take = lambda tokens: [t.strip() for x in tokens or [] for t in x.split(",") if t.strip()]
        inc = lambda ts: tuple(t for t in ts if t[0] != "^")
        exc = lambda ts: tuple(t[1:] for t in ts if t[0] == "^")
        p, t = take(phenotype), take(tech)
        return cls(inc(p), exc(p), inc(t), exc(t), sex, min_pass, min_observed, min_quality_evidence)

    def narrowed(self, sex: str | None = None, tech: str | None = None, phenotype: str | None = None) -> "SampleFilter":
        """The filter of a group: a given value takes the place of the list it belongs to, exclusions stay."""
        f = self
        if sex is not None:
            f = replace(f, sex=sex)
        if tech is not None:
            f = replace(f, tech_include=(tech,))
        if phenotype is not None:
            f = replace(f, phenotype_include=(phenotype,))
        return f

    def check(self, known_phenotypes: set[str], known_techs: set[str]) -> None:
        if self.sex not in ("male", "female", "both"):
            raise ValueError(f"Invalid sex {self.sex!r}: male, female or both")
        for what, inc, exc, known in (("Phenotype", self.phenotype_include, self.phenotype_exclude, known_phenotypes), ("Technology", self.tech_include, self.tech_exclude, known_techs)):
            for x in inc:
                if x not in known:
                    warnings.warn(f"{what} {x!r} is not in the cohort: including it matches no sample.", CohortWarning, stacklevel=3)
            for x in exc:
                if x not in known:
                    warnings.warn(f"{what} {x!r} is not in the cohort: excluding it has no effect.", CohortWarning, stacklevel=3)

    def member(self, codes: Column, tech_name: Column, sex: Column) -> Column:
        """Whether a sample with these phenotype codes (an array), technology and sex belongs to the sub-cohort.

        Codes to include are alternatives, as are technologies; all conditions must hold. Samples of other sexes than
        male and female never belong. Unknown (null) attributes fail what they are asked for.
        """
        array = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
        ok = sex.isin("male", "female") if self.sex == "both" else sex == self.sex
        codes = F.coalesce(codes, F.array().cast("array<string>"))
        if self.phenotype_include:
            ok = ok & F.arrays_overlap(codes, array(self.phenotype_include))
        if self.phenotype_exclude:
            ok = ok & ~F.arrays_overlap(codes, array(self.phenotype_exclude))
        if self.tech_include:
            ok = ok & tech_name.isin(*self.tech_include)
        if self.tech_exclude:
            ok = ok & ~F.coalesce(tech_name.isin(*self.tech_exclude), F.lit(False))
        return F.coalesce(ok, F.lit(False))


def sample_attributes(samples: DataFrame, sample_phenotype: DataFrame, technologies: DataFrame) -> DataFrame:
    """Samples with tech_name, always_covered and the array of their codes; one row per sample."""
    codes = sample_phenotype.groupBy("sample_id").agg(F.sort_array(F.collect_set("phenotype_code")).alias("codes"))
    techs = technologies.select("tech_id", "tech_name", "always_covered")
    return samples.join(codes, "sample_id", "left").join(F.broadcast(techs) if can_broadcast(technologies) else techs, "tech_id", "left")
