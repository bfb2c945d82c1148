"""p2, p3 and p5 against plain Python written from the statement of the problems."""

import datetime as dt
import json
import re

import pandas as pd
import pyarrow.parquet as pq

from varicohort.plans import general


def load(sf, name):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def us(text):
    if text is None:
        return None
    t = text.strip()
    if re.fullmatch(r"\d+", t):
        return int(t) * 1_000_000
    d = dt.datetime.fromisoformat(t.replace("Z", "+00:00"))
    d = d if d.tzinfo else d.replace(tzinfo=dt.timezone.utc)
    return (d - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def brute_items(cell):
    """A character scanner."""
    out, i, n = [], 0, len(cell or "")
    while i < n:
        if cell[i] in ",;|/\t\r\n ":
            i += 1
            continue
        q = cell[i]
        if q in "\"'":
            j, value = i + 1, ""
            while j < n and not (cell[j] == q and cell[j + 1 : j + 2] != q):
                if cell[j] == q:
                    j += 1
                value += cell[j]
                j += 1
            if value.strip():
                out.append(value.strip())
            i = j + 1
            continue
        j = i
        while j < n and cell[j] not in ",;|/\t\r\n":
            j += 1
        words, run = cell[i:j].split(" "), []
        for k, w in enumerate(words):
            if w[:1] in ('"', "'") and w:
                j = i + len(" ".join(words[:k])) + (1 if k else 0)
                break
            if re.fullmatch(r"[A-Z]{2}-?\d{2,3}(\.\d)?", w):
                if run:
                    out.append(" ".join(run))
                run = []
                out.append(w)
            elif w:
                run.append(w)
        if run:
            out.append(" ".join(run))
        i = j
    return out


def test_p2_against_scanner(spark, sf):
    want = {(r["row_id"], i, v) for r in load(sf, "manifest") for i, v in enumerate(brute_items(r["phenotype_codes"]), 1)}
    got = {(r.row_id, r.item_no, r.item) for r in general.p2_found(spark, sf).collect()}
    assert got == want
    terms = load(sf, "phenotype_terms")
    known = {t["code"] for t in terms} | {t["term_label"] for t in terms}
    assert all(v in known or re.fullmatch(r"[A-Z]{2}-?\d{2,3}(\.\d)?", v) for _, _, v in got)


def unwrap(x):
    while isinstance(x, str):
        x = json.loads(x)
    return x


def test_p3_against_replay(spark, sf):
    log = load(sf, "changelog")
    begun, entries = {}, {}
    for e in log:
        t = us(e["event_time"])
        if e["event_type"] in ("preprocess", "add_samples"):
            for name in json.loads(e["sample_names"]):
                begun[name] = min(begun.get(name, t), t)
        try:
            notes = unwrap(e["notes"])
        except (TypeError, ValueError):
            continue
        for k, x in enumerate(notes if isinstance(notes, list) else [notes]):
            x = unwrap(x)
            if isinstance(x, dict) and x.get("field") == "sex" and isinstance(x.get("new"), str) and x["new"].strip().lower() in ("male", "female"):
                entries.setdefault(x["sample"], []).append((t, e["event_id"], k, x.get("old"), x["new"].strip().lower()))
    want = set()
    for name, es in entries.items():
        es.sort(key=lambda x: x[:3])
        versions = [(es[0][3].strip().lower() if es[0][3] is not None else None, begun.get(name))]
        at = {}
        for t, _, _, _, new in es:
            at[t] = new
        for t, new in at.items():
            if new != versions[-1][0]:
                versions.append((new, t))
        if len(versions) > 1:
            want |= {(name, v, t) for v, t in versions}
    got = {(r.sample_name, r.sex, r.valid_from_us) for r in general.p3_found(spark, sf).collect()}
    assert got == want


def brute_cells(line):
    cells, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, v = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        v, j = v + '"', j + 2
                        continue
                    break
                v, j = v + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != "\t":
                return None
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            v = line[i:j]
            if '"' in v:
                return None
        cells.append(v)
        if j >= len(line):
            return cells
        i = j + 1


def brute_p5(rows):
    heads = {r["batch_id"]: re.sub(r"[^a-z_\t]", "", r["line_text"]).split("\t") for r in rows if r["line_no"] == 1}
    found, names = set(), {}
    for r in sorted(rows, key=lambda r: (r["batch_id"], r["line_no"])):
        if r["line_no"] == 1 or not r["line_text"].strip():
            continue
        line = r["line_text"].removesuffix("\r")
        cells = brute_cells(line)
        if cells is None:
            found.add((r["line_id"], "quoting"))
        elif len(cells) != len(heads[r["batch_id"]]):
            found.add((r["line_id"], "columns"))
        else:
            d = {k: v.strip(" ") for k, v in zip(heads[r["batch_id"]], cells)}
            if d["sex"] not in ("male", "female"):
                found.add((r["line_id"], "sex"))
            p = d["vcf_path"]
            if not p or " " in p or not p.endswith((".vcf", ".vcf.gz")):
                found.add((r["line_id"], "vcf_path"))
            if not d["sample_name"] or d["sample_name"] in names.setdefault(r["batch_id"], set()):
                found.add((r["line_id"], "sample_name"))
            names.setdefault(r["batch_id"], set()).add(d["sample_name"])
    return found


def test_p5_against_scanner(spark, sf):
    got = {(r.line_id, r.reason) for r in general.p5_found(spark, sf).collect()}
    assert got == brute_p5(load(sf, "manifest_lines"))


def test_p5_made_up_lines(spark, tmp_path):
    H = "sample_name\tsex\ttech_name\tvcf_path\tphenotype_codes"
    texts = [H, 'a\tmale\tt\tx.vcf\tc', 'a\tmale\tt\tx.vcf\tc', '"b\tmale\tt\tx.vcf\tc', 'c\tma"le\tt\tx.vcf\tc', '"d"x\tmale\tt\tx.vcf\tc', 'e\tmale\tt\tx.vcf', 'f\tmale\tt\tx.vcf\tc\td', '\t\t\t\t', '   ', "", "\r", '"g""h"\t"male"\t"t\t2"\t"x.vcf.gz"\t""\r', 'i\tmale\tt\ta b.vcf\tc', '"' * 7, "\t" * 50, "x" * 100_000, 'b\tmale\tt\tx.vcf\tc "', '"j"\tmale\tt\tx.vcf\t"c']
    rows = [{"line_id": 10 * b + k, "batch_id": b, "line_no": k + 1, "line_text": t} for b in (1, 2) for k, t in enumerate(texts)]
    for r in rows:
        r["line_id"] = r["batch_id"] * 1000 + r["line_no"]
    spark.createDataFrame(pd.DataFrame(rows)).write.parquet(f"{tmp_path}/manifest_lines.parquet")
    assert {(r.line_id, r.reason) for r in general.p5_found(spark, str(tmp_path)).collect()} == brute_p5(rows)


def test_notes_wrapped_any_number_of_times(spark):
    entry = {"sample": "S1", "field": "sex", "old": 'fe"male', "new": "Male"}
    rows = []
    for n in range(17):
        text = json.dumps(entry)
        for _ in range(n):
            text = json.dumps(text)
        rows.append((n, "UPDATE_SAMPLE", "2024-01-01", None, text))
        inner = json.dumps(entry)
        for _ in range(n % 9):
            inner = json.dumps(inner)
        many = json.dumps([json.loads(inner), 7, None])
        for _ in range(n // 3):
            many = json.dumps(many)
        rows.append((100 + n, "UPDATE_SAMPLE", "2024-01-01", None, many))
    dense = json.dumps(entry)  # escapes that do not double
    for n in range(40):
        dense = '"' + dense.replace("\\", "\\u005c").replace('"', "\\u0022") + '"'
        rows.append((200 + n, "UPDATE_SAMPLE", "2024-01-01", None, dense))
        if len(dense) > 3_000_000:
            break
    rows += [(900, "x", "2024-01-01", None, '"'), (901, "x", "2024-01-01", None, '"sex'), (902, "x", "2024-01-01", None, '"\\"sex\\""')]
    log = spark.createDataFrame(rows, "event_id bigint, event_type string, event_time string, sample_names string, notes string")
    got = {r.event_id: (r.sample_name, r.old, r.new) for r in general.sex_entries(log).collect()}
    assert got == {r[0]: ("S1", 'fe"male', "male") for r in rows if r[0] < 900}


def test_times_of_digits(spark):
    from pyspark.sql import functions as F

    from varicohort.functions.times import instant_us

    texts = ["0", "1700000000", "0001700000000", "9" * 12, "9223372036854", "9223372036855", "9" * 19, "0" * 30 + "5", "1" * 40, " 12 ", "-5", "1e3", ""]
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", instant_us(F.col("t")).alias("v")).collect()}
    fits = lambda t: t.strip().isdigit() and int(t) * 10**6 < 1 << 63
    assert got == {t: int(t) * 10**6 if fits(t) else None for t in texts}


def test_number_keys(spark):
    from decimal import Decimal, InvalidOperation

    from pyspark.sql import functions as F

    texts = ["6", "06", "6.0", "6.", "+6", "60", "6e1", "600E-1", "7.0000004", "7", "7.0000000000000000000000000000000000001", ".5", "0.50", "0", "-0", "00.0", "-1", "-01.0", "1e400", "10e399", "x", ".", "", "1_0"]
    got = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", general.number_key(F.col("t")).alias("k")).collect()}

    def number(t):
        try:
            return Decimal(t) if "_" not in t else t
        except InvalidOperation:
            return t

    assert all((got[a] == got[b]) == (number(a) == number(b)) for a in texts for b in texts)
