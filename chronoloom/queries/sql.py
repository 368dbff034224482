"""Building blocks of the checking SQL: the same panels as ``panels.py``, in SQL."""

from __future__ import annotations

from chronoloom.spec import CALENDAR, POLLUTANTS, WEATHER

TARGETS = list(POLLUTANTS)
DRIVERS = list(WEATHER)
MEASURED = TARGETS + DRIVERS


def r(expr: str, name: str, digits: int = 4) -> str:
    """Rounded as ``panels.settled`` rounds; the last term turns -0.0 into 0.0."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-7, {digits}) + CAST(0 AS DOUBLE) AS {name}"


def rs(cols: list[str], digits: int = 4, prefix: str = "") -> str:
    return ", ".join(r(f"{prefix}{c}", c, digits) for c in cols)


def event_hours(key: str) -> str:
    return (
        f"SELECT CAST({key} AS VARCHAR) AS series_id, date_trunc('hour', ts) AS time, avg(value) AS y "
        "FROM events GROUP BY 1, 2"
    )


def on_spine(observed: str, values: str, step: str = "1 HOUR") -> str:
    """CTE list defining ``obs`` and ``panel`` (every tick of each series)."""
    return f"""
      obs AS ({observed}),
      bounds AS (SELECT series_id, min(time) AS lo, max(time) AS hi FROM obs GROUP BY 1),
      ticks AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL {step})) AS time FROM bounds),
      panel AS (SELECT t.series_id, t.time, {values}
                FROM ticks t LEFT JOIN obs o ON o.series_id = t.series_id AND o.time = t.time)"""


TYPE_PANEL = on_spine(event_hours("event_type"), "o.y")
USER_PANEL = on_spine(event_hours("user_id"), "o.y")

STATION_OBS = """
  SELECT event_type AS series_id, date_trunc('hour', ts) AS time,
         avg(value) AS pm10, min(value) AS pm2_5, max(value) AS carbon_monoxide,
         sum(value) AS nitrogen_dioxide, avg(k) AS sulphur_dioxide, max(k) AS ozone,
         CAST(count(*) AS DOUBLE) AS temperature, CAST(max(user_id % 17) AS DOUBLE) AS wind_speed
  FROM (SELECT *, TRY_CAST(regexp_extract(props, '"k": *([0-9.]+)', 1) AS DOUBLE) AS k FROM events)
  GROUP BY 1, 2"""
STATION_PANEL = on_spine(
    STATION_OBS,
    ", ".join(f"o.{c}" for c in TARGETS) + ", " + ", ".join(f"coalesce(o.{c}, 0.0) AS {c}" for c in DRIVERS),
)

# The wide panel as uploaded: no targets in the last 80 hours.
UPLOAD = STATION_PANEL + """,
      last AS (SELECT series_id, max(time) AS last_time FROM panel GROUP BY 1),
      upload AS (SELECT p.series_id, p.time, """ + ", ".join(
    f"CASE WHEN p.time <= l.last_time - INTERVAL 80 HOUR THEN p.{c} END AS {c}" for c in TARGETS
) + ", " + ", ".join(f"p.{c}" for c in DRIVERS) + """
                 FROM panel p JOIN last l ON l.series_id = p.series_id)"""

ALL_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in MEASURED)


def cutoffs(source: str) -> str:
    """CTE ``cuts``: last fully observed row that is not the final row."""
    return f"""
      ends AS (SELECT series_id, max(time) AS last_row FROM {source} GROUP BY 1),
      cuts AS (SELECT u.series_id, max(CASE WHEN {ALL_KNOWN} AND u.time < e.last_row THEN u.time END) AS cutoff_ts
               FROM {source} u JOIN ends e ON e.series_id = u.series_id GROUP BY 1)"""


def neighbours(cols: list[str], at: str) -> str:
    """Select list with the nearest known coordinate and value on each side."""
    out = []
    for c in cols:
        for kind, fn, frame in (
            ("p", "last_value", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
            ("n", "first_value", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
        ):
            over = f"OVER (PARTITION BY series_id ORDER BY time {frame})"
            out.append(f"{fn}(CASE WHEN {c} IS NOT NULL THEN {at} END IGNORE NULLS) {over} AS {kind}a_{c}")
            out.append(f"{fn}({c} IGNORE NULLS) {over} AS {kind}v_{c}")
    return ", ".join(out)


def line(c: str, at: str) -> str:
    return f"(pv_{c} + (nv_{c} - pv_{c}) * (({at} - pa_{c}) * 1.0 / (na_{c} - pa_{c})))"


def filled(c: str, inner: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pa_{c} IS NULL THEN nv_{c} "
        f"WHEN na_{c} IS NULL THEN pv_{c} ELSE {inner} END"
    )


def limited(c: str, at: str = "sec", reach: int = 6 * 3600) -> str:
    near = f"({at} - pa_{c} <= {reach} OR na_{c} - {at} <= {reach})"
    return filled(c, f"CASE WHEN {near} THEN {line(c, at)} ELSE {line(c, f'(pa_{c} + {reach})')} END")


SECONDS = "CAST(epoch(time) AS BIGINT)"


def calendar() -> list[tuple[str, str]]:
    parts = {"h": ("hour(time)", 2, 24), "h2": ("hour(time)", 4, 24),
             "dow": ("(isodow(time) - 1)", 2, 7), "mon": ("month(time)", 2, 12)}
    out = []
    for name, (part, turns, period) in parts.items():
        for fn in ("sin", "cos"):
            out.append((f"{name}_{fn}", f"{fn}({turns} * pi() * {part} / {period})"))
    assert [n for n, _ in out] == list(CALENDAR)
    return out


# Past rows up to the detected cutoff, filled; future rows after it.
PAST = UPLOAD + "," + cutoffs("upload") + f""",
      past AS (SELECT u.* FROM upload u JOIN cuts c ON c.series_id = u.series_id WHERE u.time <= c.cutoff_ts),
      near AS (SELECT *, {SECONDS} AS sec, {neighbours(MEASURED, SECONDS)} FROM past),
      filled AS (SELECT series_id, time, """ + ", ".join(f"{limited(c)} AS {c}" for c in MEASURED) + """ FROM near),
      future AS (SELECT u.*, CAST((epoch(u.time) - epoch(c.cutoff_ts)) / 3600 AS INTEGER) AS step
                 FROM upload u JOIN cuts c ON c.series_id = u.series_id WHERE u.time > c.cutoff_ts)"""


def naive(horizon: int, season: int = 24) -> str:
    """CTE ``predicted``: the last ``season`` filled rows repeated over the future."""
    picks = ", ".join(f"p.{c} AS {c}" for c in TARGETS)
    return PAST + f""",
      placed AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time DESC) AS back FROM filled),
      enough AS (SELECT series_id FROM future GROUP BY 1 HAVING max(step) >= {horizon}),
      predicted AS (SELECT f.series_id, f.time, f.step, {picks}, f.temperature AS temperature_used, f.wind_speed AS wind_speed_used
        FROM future f JOIN enough e ON e.series_id = f.series_id
        JOIN placed p ON p.series_id = f.series_id AND p.back = {season} - ((f.step - 1) % {season})
        WHERE f.step <= {horizon})"""
