"""Property test: period metrics equal a brute-force computation of the
definitions on random observation sets (including null users, taxa and
dates, repeated ids and year-boundary weeks)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sightline.operators import period_metrics as pm
from sightline.schema import RAW_OBSERVATION

START, END = dt.date(2018, 1, 1), dt.date(2021, 12, 31)

days = st.one_of(st.none(), st.dates(min_value=dt.date(2018, 12, 20), max_value=dt.date(2021, 1, 10)))
rows = st.lists(
    st.tuples(
        st.integers(1, 40),  # id (repeats on purpose)
        days,
        st.one_of(st.none(), st.integers(1, 8)),  # user
        st.one_of(st.none(), st.integers(1, 6)),  # taxon
    ),
    min_size=1,
    max_size=60,
)


def monday(d):
    return d - dt.timedelta(days=d.weekday())


PERIOD = {
    "day": lambda d: d,
    "week": monday,
    "month": lambda d: d.replace(day=1),
    "quarter": lambda d: dt.date(d.year, 3 * ((d.month - 1) // 3) + 1, 1),
}
PCOL = {"day": "date", "week": "week", "month": "month", "quarter": "quarter"}


def next_period(p, grain):
    if grain in ("day", "week"):
        return p + dt.timedelta(days=1 if grain == "day" else 7)
    months = 1 if grain == "month" else 3
    m = p.month - 1 + months
    return dt.date(p.year + m // 12, m % 12 + 1, 1)


def brute_force(data, grain, as_of):
    period = PERIOD[grain]
    cal, p = [], period(START)
    while p <= period(END):
        if p <= as_of:
            cal.append(p)
        p = next_period(p, grain)
    dated = [r for r in data if r[1] is not None]
    first = {}
    for kind, idx in (("users", 2), ("species", 3)):
        f = {}
        for r in dated:
            if r[idx] is not None:
                f[r[idx]] = min(f.get(r[idx], r[1]), r[1])
        first[kind] = f
    out, cum = {}, {"users": 0, "species": 0, "observations": 0}
    for p in cal:
        in_p = [r for r in dated if period(r[1]) == p]
        row = {}
        for kind, idx in (("users", 2), ("species", 3), ("observations", 0)):
            row[f"unique_{kind}"] = len({r[idx] for r in in_p if r[idx] is not None})
            if kind == "observations":
                cum[kind] += row[f"unique_{kind}"]
            else:
                row[f"new_{kind}"] = sum(1 for d in first[kind].values() if period(d) == p)
                cum[kind] += row[f"new_{kind}"]
            row[f"cumulative_{kind}"] = cum[kind]
        out[p] = row
    return out


@settings(max_examples=16, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=rows,
    grain=st.sampled_from(["week", "day", "month", "quarter"]),
    as_of=st.dates(dt.date(2019, 6, 1), dt.date(2021, 12, 31)),
)
def test_period_summary_matches_brute_force(spark, data, grain, as_of):
    records = [(i, None, d, None, u, None, None, None, t, None, None) for i, d, u, t in data]
    obs = spark.createDataFrame(records, RAW_OBSERVATION)
    got = pm.period_summary(obs, grain=grain, as_of=as_of, start=START, end=END).collect()
    expected = brute_force(data, grain, as_of)
    pcol = PCOL[grain]
    assert sorted(r[pcol] for r in got) == sorted(expected)
    for r in got:
        want = expected[r[pcol]]
        assert {k: r[k] for k in want} == want, r[pcol]
