"""The record loader against a reader that goes character by character."""

import random
import re
from datetime import date

import pytest

from memquarry.operators import row_errors

SPACE = " \t\n\r\f"


def fields(raw):
    if raw.endswith("\r"):
        raw = raw[:-1]
    out, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            i, s = i + 1, ""
            while True:
                if i >= len(raw):
                    return None
                if raw[i] == '"':
                    if raw[i + 1 : i + 2] == '"':
                        s, i = s + '"', i + 2
                        continue
                    i += 1
                    break
                s, i = s + raw[i], i + 1
            if i < len(raw) and raw[i] != ",":
                return None
        else:
            j = raw.find(",", i)
            j = len(raw) if j < 0 else j
            s, i = raw[i:j], j
        out.append(s)
        if i >= len(raw):
            return out
        i += 1


def reason(raw):
    if raw is None:
        return "column_count"
    f = fields(raw)
    if f is None:
        return "quoting"
    if len(f) != 6:
        return "column_count"
    d, who, hours, task, act, text = (x.strip(SPACE) for x in f)
    try:
        ok = bool(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", d)) and bool(date.fromisoformat(d))
    except ValueError:
        ok = False
    if not ok:
        return "date"
    if not 1 <= len(who) <= 100:
        return "timekeeper"
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)?", hours) or not 0 < float(hours) <= 24:
        return "hours"
    for c, n in ((task, "task_code"), (act, "activity_code")):
        if c and not re.fullmatch("[A-Za-z][0-9]{3}", c):
            return n
    return "narrative" if not text else None


GOOD = "2025-01-31,Ann,1.5,L100,A101,text"
CASES = [
    GOOD, GOOD + "\r", GOOD + "\r\r", "", None, ",", ",,,,,", "a", '"a', '"a"b,c', 'a"b,c', '""', '"""', '""""', '2025-01-31,"A ""B"", C",24,,,"x\ny"',
    "2025-02-30,Ann,1,,,t", "0000-01-01,Ann,1,,,t", "2025-1-31,Ann,1,,,t", "2025-01-31,Ann,24.0000000000000000001,,,t", "2025-01-31,Ann,0.000,,,t", "2025-01-31,Ann,.5,,,t",
    "2025-01-31,Ann,1.,,,t", "2025-01-31,Ann,+1,,,t", "2025-01-31,Ann,007.5,,,t", "2025-01-31,,1,,,t", f"2025-01-31,{'é' * 100},1,,,t", f"2025-01-31,{'é' * 101},1,,,t",
    "2025-01-31,Ann,1,l100,,t", "2025-01-31,Ann,1,L10,,t", "2025-01-31,Ann,1,,A1011,t", "2025-01-31,Ann,1,,, ", " 2025-01-31 , Ann ,\t3.5 , L100 ,,t", '2025-01-31,Ann, "1",,,t', "2025-01-31,Ann,1,,,t,",
]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(4)
    made = ["".join(rng.choice(['"', ",", "a", "1", "\n", "\r", " "]) for _ in range(rng.randrange(12))) for _ in range(1500)]
    parts = ["2025-01-31", '"x"', "24", "L100", "", 'a"b', '"q""q"', '"', "1.5", " A101 "]
    made += [",".join(rng.choice(parts) for _ in range(rng.choice([5, 6, 6, 6, 7]))) for _ in range(1500)]
    made += ['2025-01-31,Ann,1,,,"' + '""' * 200_000 + '"', "x" * 500_000, "," * 50_000]
    rows = list(enumerate(CASES + made))
    df = spark.createDataFrame([(i, r, "t") for i, r in rows], "line_id long, raw string, reason string")
    good, bad = row_errors.time_entries(df)
    return dict(rows), {r["line_id"] for r in good.select("line_id").collect()}, {r["line_id"]: r["reason"] for r in bad.select("line_id", "reason").collect()}


def test_reasons(found):
    rows, good, bad = found
    want = {i: reason(r) for i, r in rows.items()}
    # A double cannot tell 24.0000000000000000001 from 24; the loader can.
    want[CASES.index("2025-01-31,Ann,24.0000000000000000001,,,t")] = "hours"
    assert good == {i for i, w in want.items() if w is None}
    assert bad == {i: w for i, w in want.items() if w}


def test_empty_table(spark):
    good, bad = row_errors.time_entries(spark.createDataFrame([], "raw string"))
    assert good.count() == bad.count() == 0


def test_typed_values(spark):
    df = spark.createDataFrame([('2025-01-31,"Ann, B",07.5,l100,,"a ""b"""',)] * 2, "raw string")
    good, _ = row_errors.time_entries(df)
    r = good.collect()
    assert len(r) == 2  # repeated rows are kept
    assert (str(r[0]["date"]), r[0]["timekeeper"], float(r[0]["hours"]), r[0]["task_code"], r[0]["activity_code"], r[0]["narrative"]) == ("2025-01-31", "Ann, B", 7.5, "L100", None, 'a "b"')
