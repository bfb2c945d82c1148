"""The measures against golden values and against sets, sample by sample."""

import random

import pytest

from varicohort.operators.coverage import merge_intervals
from varicohort.operators.filters import CohortWarning, SampleFilter
from varicohort.operators.measures import MEASURES, measures, measures_by_group
from varicohort.plans.cohort import Cohort, Quality, make_cohort
from varicohort.plans import queries as Q
from varicohort.plans.export import build_groups, dump
from varicohort.session import rows_table

# Pseudo-autosomal regions, and the cohort for which the golden values below hold.
PAR37 = [(60001, 2699520), (154931044, 155260560)]
SEX = ["male", "male", "female", "female", "male", "female", "female", "male", "male", "female"]
TECH = [0, 0, 0, 0, 1, 1, 1, 2, 2, 2]
CODES = [["E11.9", "J45"], ["E11.9", "I10", "G20"], ["E11.9", "C50", "G20"], ["I10", "J45", "G20"], ["C50"], ["E11.9", "I10", "G20"], ["E11.9", "C50"], ["E11.9", "J45"], ["I10", "J45"], ["I10", "J45"]]
VARIANTS = {
    ("chr1", 1500, "A", "T"): ({0, 5}, {2}, {0}), ("chr1", 3500, "G", "C"): ({7}, set(), set()), ("chr1", 5000, "T", "G"): ({0, 1}, {3}, {1, 3}),
    ("chrX", 5000000, "A", "G"): ({0, 2}, set(), set()), ("chrY", 500000, "T", "C"): ({0, 1}, {4}, set()), ("chrM", 100, "C", "A"): ({0, 2, 5}, set(), {5}),
}
CALLS = "chrom string, pos int, ref string, alt string, sample_id int, is_het boolean, is_hom boolean, is_fail boolean, is_qp boolean"


@pytest.fixture(scope="module")
def cohort(spark):
    calls = [(*v, s, s in het, s in hom, s in fail, s in het | hom) for v, (het, hom, fail) in VARIANTS.items() for s in het | hom | fail]
    return Cohort(
        rows_table(spark, calls, CALLS),
        rows_table(spark, [(i, f"S{i:02}", SEX[i], TECH[i]) for i in range(10)], "sample_id int, sample_name string, sex string, tech_id int"),
        rows_table(spark, [(i, c) for i, cs in enumerate(CODES) for c in cs], "sample_id int, phenotype_code string"),
        rows_table(spark, [(0, "WGS", True), (1, "WES_kit_A", False), (2, "WES_kit_B", False)], "tech_id int, tech_name string, always_covered boolean"),
        rows_table(spark, [(1, "chr1", 999, 2000), (1, "chrX", 999, 2000), (2, "chr1", 2999, 4000)], "tech_id int, chrom string, start0 int, end0 int"),
    )


def values(cohort, chrom, pos, **sf):
    rows = Q.point(cohort, chrom, pos, SampleFilter.parse(**sf)).collect()
    return [tuple(r[k] for k in ("AC", "AN", "n_eligible", "N_HET", "N_HOM_ALT", "N_HOM_REF", "N_FAIL", "N_NO_COVERAGE")) for r in rows]


@pytest.mark.parametrize(
    "sf, chrom, pos, want",
    [
        ({"phenotype": ["E11.9"]}, "1", 1500, (4, 10, 5)), ({"phenotype": ["E11.9"], "sex": "female"}, "chr1", 1500, (3, 6, 3)), ({"phenotype": ["E11.9"]}, "X", 5000000, (2, 4, 3)),
        ({"phenotype": ["J45"]}, "chrY", 500000, (1, 1, 2)), ({"phenotype": ["E11.9"]}, "MT", 100, (2, 3, 3)),
        ({}, "chr1", 1500, (4, 14, 7, 2, 1, 3, 1, 0)), ({}, "chr1", 3500, (1, 14, 7, 1, 0, 6, 0, 0)), ({}, "chr1", 5000, (4, 8, 4, 2, 1, -1, 2, 0)), ({}, "chrX", 5000000, (2, 6, 4, 1, 1, 2, 0, 0)),
        ({}, "chrY", 500000, (2, 2, 4, 0, 2, 2, 0, 0)), ({}, "chrM", 100, (2, 4, 4, 0, 2, 2, 0, 0)),
        ({"sex": "female"}, "chr1", 1500, (3, 8, 4, 1, 1, 2, 0, 0)), ({"sex": "female"}, "chr1", 3500, (0, 6, 3, 0, 0, 3, 0, 0)), ({"sex": "female"}, "chrX", 5000000, (1, 4, 2, 1, 0, 1, 0, 0)),
        ({"sex": "female"}, "chrY", 500000, None), ({"phenotype": ["^E11.9"]}, "chr1", 1500, (0, 4, 2, 0, 0, 2, 0, 0)), ({"phenotype": ["E11.9,^C50"]}, "chr1", 1500, (2, 6, 3, 2, 0, 0, 1, 0)),
        ({"tech": ["WGS"]}, "chr1", 1500, (3, 8, 4, 1, 1, 1, 1, 0)), ({"tech": ["WGS"]}, "chr1", 3500, (0, 8, 4, 0, 0, 4, 0, 0)), ({"min_pass": 2}, "chr1", 1500, (4, 14, 7, 2, 1, 1, 1, 2)), ({"min_pass": 2}, "chr1", 3500, (1, 14, 7, 1, 0, 4, 0, 2)),
    ],
)
def test_golden(cohort, sf, chrom, pos, want):
    got = values(cohort, chrom, pos, **sf)
    assert got == [] if want is None else [g[: len(want)] for g in got] == [want]


def test_empty_and_unknown(cohort, spark):
    assert values(cohort, "chr9", 1) == [] and values(cohort, "chr1", 1500, phenotype=["none"]) == []
    assert measures(cohort.with_(calls=cohort.calls.limit(0)), SampleFilter()).collect() == []
    assert measures(cohort.with_(samples=cohort.samples.limit(0)), SampleFilter()).collect() == []
    with pytest.raises(ValueError):
        SampleFilter(sex="x").check(set(), set())
    with pytest.warns(CohortWarning):
        SampleFilter.parse(["^A"]).check({"B"}, set())


def brute(calls, samples, capture, sf, quality):
    covers = lambda t, c, p: t == 0 or any(t == k and c == x and a < p <= b for k, x, a, b in capture)
    inside = {i for i, s, t, codes in samples if s in ("male", "female") and sf.sex in ("both", s) and (not sf.phenotype_include or set(sf.phenotype_include) & codes) and not set(sf.phenotype_exclude) & codes}
    of = {i: (s, t) for i, s, t, _ in samples}
    out = {}
    for v in {c[:4] for c in calls if c[6] is False or c[4] in (1, 2)}:
        chrom, pos = v[:2]
        rows = [c for c in calls if c[:4] == v]
        het, hom, fail = ({c[5] for c in rows if c[6] and c[4] == 1}, {c[5] for c in rows if c[6] and c[4] == 2}, {c[5] for c in rows if not c[6]})
        good = lambda c: c[6] and c[4] > 0 and all(x <= 0 or (y is not None and y >= x) for x, y in ((quality.min_dp, c[7]), (quality.min_gq, c[8])))
        qp = {c[5] for c in rows if good(c)}
        el = {i for i in inside if covers(of[i][1], chrom, pos)}
        ploidy = lambda i: 1 if chrom == "chrM" else (of[i][0] == "male") if chrom == "chrY" else 1 if chrom == "chrX" and of[i][0] == "male" and not any(a <= pos <= b for a, b in PAR37) else 2
        hap, dip = {i for i in el if ploidy(i) == 1}, {i for i in el if ploidy(i) == 2}
        an = len(hap) + 2 * len(dip)
        if not an:
            continue
        ac = len((het | hom) & hap) + len(het & dip) + 2 * len(hom & dip)
        n_het, n_hom, n_fail = len(het & dip), len(hom & dip) + len((het | hom) & hap), len(fail & el)
        no = set()
        for t in {t for _, t in of.values()} - {0}:
            mine = {i for i in el if of[i][1] == t}
            fails = (sf.min_pass or sf.min_observed) and (len((het | hom) & mine) < sf.min_pass or len((het | hom | fail) & mine) < sf.min_observed)
            fails = fails or quality.min_covered and len({i for i in qp if of[i][1] == t}) < quality.min_covered
            fails = fails or len(qp & mine) < sf.min_quality_evidence
            if fails:
                no |= mine - het - hom - fail
        out[v] = (ac, an, ac / an, len(el), n_het, n_hom, len(el) - n_het - n_hom - n_fail - len(no), n_fail, len(no))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_cohorts(spark, seed):
    rng = random.Random(seed)
    quality = Quality(min_dp=10, min_gq=20, min_covered=1) if seed % 2 else Quality()
    samples = [(i, rng.choice(["male", "female", "male", "female", "other"]), rng.randrange(4), {c for c in "ABC" if rng.random() < 0.4}) for i in range(30)]
    capture = [(t, c, a, a + rng.randint(50, 3000)) for t in (1, 2, 3) for c in ("chr1", "chrX", "chrY") for a in (rng.randint(0, 5000) for _ in range(3))]
    spots = [(c, rng.choice([rng.randint(1, 8000), 60000 + rng.randint(0, 2)]), "A", rng.choice("CT")) for c in ("chr1", "chrX", "chrY", "chrM") for _ in range(5)]
    calls = [(*v, rng.choice([0, 1, 1, 2, 3]), i, rng.random() < 0.75, rng.choice([None, 5, 30]), rng.choice([None, 10, 50])) for v in spots for i in range(30) if rng.random() < 0.3]
    calls = [c if c[4] or not c[6] else (*c[:4], 1, *c[5:]) for c in calls]
    calls += [(*c[:4], 2, *c[5:]) for c in calls[::9]]  # one sample in two classes
    cohort = make_cohort(
        rows_table(spark, [(*c, None) for c in calls], "chrom string, pos int, ref string, alt string, gt_ac tinyint, sample_id int, filter_pass boolean, dp int, gq int, qual float"),
        rows_table(spark, [(i, f"s{i}", s, t) for i, s, t, _ in samples], "sample_id int, sample_name string, sex string, tech_id int"),
        rows_table(spark, [(i, c) for i, _, _, cs in samples for c in cs], "sample_id int, phenotype_code string"),
        rows_table(spark, [(t, f"t{t}", t == 0) for t in range(4)], "tech_id int, tech_name string, always_covered boolean"),
        rows_table(spark, capture, "tech_id int, chrom string, start0 int, end0 int"),
        quality=quality,
    )
    cohort = cohort.with_(calls=cohort.calls.cache())
    filters = [SampleFilter(), SampleFilter.parse(["A,B", "^C"], "female", None, 2, 3, 1 if seed % 2 else 0)]
    for sf in filters:
        got = {tuple(r)[:4]: tuple(r)[4:] for r in measures(cohort, sf).select("chrom", "pos", "ref", "alt", *MEASURES).collect()}
        assert got == brute(calls, samples, capture, sf, quality)
    rows = measures_by_group(cohort, [SampleFilter(), SampleFilter(sex="male"), SampleFilter(phenotype_include=("A",))]).collect()
    grouped = {(k, *tuple(r)[:4]): tuple(g[m] for m in MEASURES) for r in rows for k, g in enumerate(r["g"]) if g["AN"]}
    for k, sf in enumerate([SampleFilter(), SampleFilter(sex="male"), SampleFilter(phenotype_include=("A",))]):
        assert {v[1:]: x for v, x in grouped.items() if v[0] == k} == brute(calls, samples, capture, sf, quality)


def test_dump_groups(cohort):
    groups = build_groups(cohort, SampleFilter(), by_sex=True, by_phenotype=["E11.9"])
    assert list(groups) == ["male_E11.9", "female_E11.9"]
    rows = {(r.chrom, r.pos): r for r in dump(cohort, SampleFilter(), groups).collect()}
    y = rows["chrY", 500000]
    assert (y["AC"], y["AC_male_E11.9"], y["AN_female_E11.9"], y["AF_female_E11.9"]) == (2, 2, 0, 0.0)
    with pytest.raises(ValueError):
        dump(cohort, start=5)


def test_merge_intervals(spark):
    c = rows_table(spark, [(1, "a", 0, 5), (1, "a", 5, 8), (1, "a", 3, 4), (1, "a", 9, 9), (1, "a", 10, 12), (2, "a", 1, 2), (1, None, None, 3)], "tech_id int, chrom string, start0 int, end0 int")
    assert sorted(map(tuple, merge_intervals(c).collect())) == [(1, "a", 0, 8), (1, "a", 10, 12), (2, "a", 1, 2)]
