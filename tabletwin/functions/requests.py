"""Request extraction (EX1-EX23): a column of short English requests -> generation fields.

Every field is a SQL expression over ``p = lower(trim(prompt))`` built from regexp_extract(_all), array
lambdas and CASE. One rule set is rendered for Spark (``selectExpr``: Catalyst expressions, no UDF) and
for DuckDB (the oracle), so both engines run the same rules. Where the two regex dialects differ, the
rule uses the common subset (the one look-behind is written as a consumed prefix class).

Mended on purpose (quirks Q4-Q6 of the reference): an age range after "vehicle", "old cars" and
"manual steering" no longer set customer age / transmission.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Fixed values that must equal the reference: patterns, keyword lists, presets, labels.
UNIT = r"(?:rows?|records?|entries|samples?|data\s*points?)"
P_ROWS_K = r"\b(\d+(?:\.\d+)?)\s*k\s*" + UNIT + r"\b"
P_ROWS = r"\b(\d+)\s*" + UNIT + r"\b"
P_VERB = r"(?:generate|create|make|produce)\s+(\d+)\b"
P_ASSIGN = r"\b(m\d+)\s*[=:x×]\s*(\d+)\b"
P_COUNT = r"(?:^|[^=:x×])\b(\d+)\s+(m\d+)\b"
P_PCT = r"(\d+(?:\.\d+)?)\s*%\s*(m\d+)"
P_ONLY = r"(?:only|all|exclusively|just)\s+(m\d+)\b|\b(m\d+)\s+only\b"
P_EXCL = r"(?:no|exclude|without|except|not)\s+(m\d+)\b"
P_REST = r"(?:rest|remaining|other).*?(m\d+)"
P_KEY = r"\b(m\d+)\b"
FUELS = [("diesel", "Diesel"), ("petrol", "Petrol"), ("cng", "CNG")]
P_SEG = (r"\b(?:segment|seg)\s*(a|b1|b2|c1|c2|utility)\b|\b(a|b1|b2|c1|c2|utility)\s*segment\b"
         r"|\b(utility)\s*(?:vehicles?)?\b")
P_AUTO = r"\b(?:automatic|auto)\b"
P_MANUAL = r"\bmanual\b"
P_STEER = r"\b(power|electric|manual)\s*steering\b"
P_DISC = r"\bdisc\s*brakes?\b"
P_DRUM = r"\bdrum\s*brakes?\b"
SAFETY = [("esc", "is_esc", "Esc"), ("tpms", "is_tpms", "Tpms"), ("parking sensor", "is_parking_sensors", "Parking Sensors"),
          ("parking camera", "is_parking_camera", "Parking Camera"), ("fog light", "is_front_fog_lights", "Front Fog Lights"),
          ("rear wiper", "is_rear_window_wiper", "Rear Window Wiper"), ("brake assist", "is_brake_assist", "Brake Assist"),
          ("power lock", "is_power_door_locks", "Power Door Locks"), ("central lock", "is_central_locking", "Central Locking"),
          ("speed alert", "is_speed_alert", "Speed Alert"), ("ecw", "is_ecw", "Ecw")]
P_ON = r"(?:with|has|enable)\s+"
P_OFF = r"(?:without|no|disable)\s+"
P_NCAP = r"(?:ncap|star)\s*(\d)\+?"
P_STAR = r"(\d)\s*star"
P_AGE = r"(?:customer\s*)?age\s*(\d+)\s*[-–to]+\s*(\d+)"
P_VAGE = r"vehicle\s*age\s*(\d+)\s*[-–to]+\s*(\d+)"
P_MIDDLE = r"\bmiddle\s*aged?\b"
P_OLD = r"\b(?:old|senior|elderly)\b"
P_NEW_CARS = r"\b(?:brand\s*new|new\s*cars?|new\s*vehicles?)\b"
P_OLD_CARS = r"\b(?:old\s*cars?|old\s*vehicles?|used\s*cars?)\b"
P_SUB = r"subscription\s*(?:length)?\s*(\d+)\s*[-–to]+\s*(\d+)"
P_REGION = r"region\s*(?:code)?\s*(c\d+)"
P_RATE0 = r"\bno\s*claims?\b|\bzero\s*claims?\b|\b0\s*%?\s*claim"
P_RATE1 = r"\ball\s*claims?\b|\b100\s*%\s*claim"
P_RATE = r"(\d+(?:\.\d+)?)\s*%\s*claim"
AGE_PRESETS = {"young": (18, 35), "middle": (35, 50), "old": (55, 75)}
VAGE_PRESETS = {"new": (0, 2), "old": (8, 20)}
RATE_PRESETS = {"none": 0.0, "all": 1.0, "high": 0.15, "low": 0.02}


class Dialect:
    """The few spellings that differ between Spark SQL and DuckDB."""

    def __init__(self, engine: str):
        self.spark = engine == "spark"

    def s(self, text: str) -> str:
        """A string literal (regexes included)."""
        if self.spark:
            return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + text.replace("'", "''") + "'"

    def ext(self, x: str, pat: str, g: int) -> str:
        return f"regexp_extract({x}, {self.s(pat)}, {g})"

    def opt(self, x: str, pat: str, g: int) -> str:
        return f"nullif({self.ext(x, pat, g)}, '')"

    def has(self, x: str, pat: str) -> str:
        return f"({self.ext(x, pat, 0)} <> '')"

    def all(self, x: str, pat: str, g: int) -> str:
        return f"regexp_extract_all({x}, {self.s(pat)}, {g})"

    def sub(self, x: str, pat: str, rep: str) -> str:
        return f"regexp_replace({x}, {self.s(pat)}, {self.s(rep)})" if self.spark else \
               f"regexp_replace({x}, {self.s(pat)}, {self.s(rep)}, 'g')"

    def lam(self, args: str, body: str) -> str:
        if self.spark:
            return f"({args}) -> {body}" if "," in args else f"{args} -> {body}"
        return f"lambda {args}: {body}"

    def map(self, a: str, args: str, body: str) -> str:
        return f"transform({a}, {self.lam(args, body)})" if self.spark else f"list_transform({a}, {self.lam(args, body)})"

    def filt(self, a: str, args: str, body: str) -> str:
        return f"filter({a}, {self.lam(args, body)})" if self.spark else f"list_filter({a}, {self.lam(args, body)})"

    def idx(self, i: str) -> str:
        """1-based position of the element bound to lambda index ``i``."""
        return f"({i} + 1)" if self.spark else i

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, TRY_CAST({i} AS INT))" if self.spark else f"list_extract({a}, {i})"

    def pos(self, a: str, x: str) -> str:
        return f"array_position({a}, {x})" if self.spark else f"list_position({a}, {x})"

    def contains(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})" if self.spark else f"list_contains({a}, {x})"

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def cat(self, *arrays: str) -> str:
        if self.spark:
            return f"concat({', '.join(arrays)})"
        out = arrays[0]
        for a in arrays[1:]:
            out = f"list_concat({out}, {a})"
        return out

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def join(self, a: str, sep: str) -> str:
        return f"concat_ws({self.s(sep)}, {a})" if self.spark else f"array_to_string({a}, {self.s(sep)})"

    def sort_distinct(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))" if self.spark else f"list_sort(list_distinct({a}))"

    def trunc_int(self, x: str) -> str:
        return f"TRY_CAST({x} AS BIGINT)" if self.spark else f"TRY_CAST(trunc({x}) AS BIGINT)"

    def fmt(self, f: str, *args: str) -> str:
        return f"{'format_string' if self.spark else 'printf'}({self.s(f)}, {', '.join(args)})"

    def thousands(self, x: str) -> str:
        return f"format_number({x}, 0)" if self.spark else f"format('{{:,}}', {x})"

    def cap(self, x: str) -> str:
        return f"CASE WHEN {x} IS NOT NULL THEN concat(upper(substr({x}, 1, 1)), substr({x}, 2)) END"

    def first(self, a: str) -> str:
        return self.at(a, "1")

    def last(self, a: str) -> str:
        return self.at(a, "-1")


def field_stages(engine: str) -> list[dict[str, str]]:
    """The rules as ordered stages of {name: SQL expression}; each stage may use the names of the stages
    before it, so every regular expression runs once per row (EX1 is the caller's ``p``)."""
    d = Dialect(engine)
    p = "p"
    up = lambda a: d.map(a, "x", "upper(x)")
    # stage 1: every regex result used more than once
    s1 = {
        "n_rows": (f"coalesce({d.trunc_int('TRY_CAST(' + d.opt(p, P_ROWS_K, 1) + ' AS DOUBLE) * 1000')}, "
                   f"TRY_CAST({d.opt(p, P_ROWS, 1)} AS BIGINT), TRY_CAST({d.opt(p, P_VERB, 1)} AS BIGINT))"),
        "_k4": up(d.all(p, P_ASSIGN, 1)), "_v4": d.all(p, P_ASSIGN, 2),
        "_k5": up(d.all(p, P_COUNT, 2)), "_v5": d.all(p, P_COUNT, 1),
        "_k6": up(d.all(p, P_PCT, 2)), "_v6": d.all(p, P_PCT, 1),
        "_only": f"upper(coalesce({d.opt(p, P_ONLY, 1)}, {d.opt(p, P_ONLY, 2)}))",
        "_excl": up(d.all(p, P_EXCL, 1)),
        "_rest": f"upper({d.opt(p, P_REST, 1)})",
        "_keys1": up(d.all(p, P_KEY, 1)),
        "_seg": f"upper(coalesce({d.opt(p, P_SEG, 1)}, {d.opt(p, P_SEG, 2)}, {d.opt(p, P_SEG, 3)}))",
        # Q6 mended: a steering phrase does not set the transmission
        "_nosteer": d.sub(p, P_STEER, " "),
        # Q4/Q5 mended: vehicle-age ranges and old-car phrases are removed before customer-age rules
        "_pa": d.sub(d.sub(p, P_VAGE, " "), P_OLD_CARS, " "),
        "_has_vage": d.has(p, P_VAGE), "_has_new": d.has(p, P_NEW_CARS), "_has_oldcars": d.has(p, P_OLD_CARS),
        **{f"_on{i}": d.has(p, P_ON + kw) for i, (kw, _, _) in enumerate(SAFETY)},
        **{f"_off{i}": d.has(p, P_OFF + kw) for i, (kw, _, _) in enumerate(SAFETY)},
    }
    # stage 2: EX5 entries kept unless they repeat the row count
    s2 = {"_k5p": d.map("_k5", "x, i", f"CASE WHEN TRY_CAST({d.at('_v5', d.idx('i'))} AS BIGINT) IS DISTINCT FROM n_rows THEN x END"),
          "_age_hit": d.has("_pa", P_AGE)}
    # stage 3: keys in order of first appearance (key=count, then kept count-key, then percent)
    s3 = {"_allk": d.cat("_k4", d.filt("_k5p", "x, i", f"x IS NOT NULL AND NOT {d.contains('_k4', 'x')} AND {d.pos('_k5p', 'x')} = {d.idx('i')}"), "_k6")}
    s4 = {"_keys": d.filt("_allk", "x, i", f"{d.pos('_allk', 'x')} = {d.idx('i')}")}

    def last_of(ks, vs, x):
        return d.last(d.filt(d.map(ks, "y, j", f"CASE WHEN y = {x} THEN {d.at(vs, d.idx('j'))} END"), "z", "z IS NOT NULL"))

    kind = f"CASE WHEN {d.contains('_k6', 'x')} THEN 'percent' ELSE 'count' END"
    val = (f"CASE WHEN {d.contains('_k6', 'x')} THEN TRY_CAST(TRY_CAST({last_of('_k6', '_v6', 'x')} AS DOUBLE) AS STRING) "
           f"WHEN {d.contains('_k4', 'x')} THEN TRY_CAST(TRY_CAST({last_of('_k4', '_v4', 'x')} AS BIGINT) AS STRING) "
           f"ELSE TRY_CAST(TRY_CAST({d.at('_v5', d.pos('_k5p', 'x'))} AS BIGINT) AS STRING) END")
    entries = d.map("_keys", "x", f"concat(x, ':', {kind}, ':', {val})")
    s5 = {"allocation": (f"CASE WHEN {d.size('_keys')} > 0 THEN {d.join(entries, ',')} "
                         f"WHEN _only IS NOT NULL THEN concat(_only, ':exclusive') END")}
    e: dict[str, str] = {}
    e["exclude"] = f"nullif({d.join(d.sort_distinct('_excl'), ',')}, '')"
    e["rest"] = (f"CASE WHEN allocation IS NOT NULL THEN coalesce(_rest, "
                 f"CASE WHEN instr({p}, 'equal') > 0 THEN 'equal' END, 'distribute') END")
    e["model"] = f"CASE WHEN allocation IS NULL THEN {d.first(d.filt('_keys1', 'x', 'NOT ' + d.contains('_excl', 'x')))} END"
    fuels = d.filt(d.arr(*[f"CASE WHEN {d.has(p, chr(92) + 'b' + f + chr(92) + 'b')} THEN {d.s(lab)} END" for f, lab in FUELS]),
                   "x", "x IS NOT NULL")
    e["fuel_types"] = f"nullif({d.join(fuels, ',')}, '')"
    e["segment"] = "CASE WHEN _seg = 'UTILITY' THEN 'Utility' ELSE _seg END"
    e["transmission_type"] = (f"CASE WHEN {d.has(p, P_AUTO)} THEN 'Automatic' "
                              f"WHEN {d.has('_nosteer', P_MANUAL)} THEN 'Manual' END")
    e["steering_type"] = d.cap(d.opt(p, P_STEER, 1))
    e["rear_brakes_type"] = f"CASE WHEN {d.has(p, P_DISC)} THEN 'Disc' WHEN {d.has(p, P_DRUM)} THEN 'Drum' END"
    on = [f"CASE WHEN _on{i} THEN {d.s(col)} END" for i, (_, col, _) in enumerate(SAFETY)]
    off = [f"CASE WHEN NOT _on{i} AND _off{i} THEN {d.s(col)} END" for i, (_, col, _) in enumerate(SAFETY)]
    e["safety_on"] = f"nullif({d.join(d.filt(d.arr(*on), 'x', 'x IS NOT NULL'), ',')}, '')"
    e["safety_off"] = f"nullif({d.join(d.filt(d.arr(*off), 'x', 'x IS NOT NULL'), ',')}, '')"
    e["ncap_min"] = f"TRY_CAST(coalesce({d.opt(p, P_NCAP, 1)}, {d.opt(p, P_STAR, 1)}) AS BIGINT)"
    yo, mi, ol = AGE_PRESETS["young"], AGE_PRESETS["middle"], AGE_PRESETS["old"]
    for j, name in ((0, "age_min"), (1, "age_max")):
        e[name] = (f"CASE WHEN _age_hit THEN TRY_CAST({d.ext('_pa', P_AGE, j + 1)} AS BIGINT) WHEN instr(_pa, 'young') > 0 THEN {yo[j]} "
                   f"WHEN {d.has('_pa', P_MIDDLE)} THEN {mi[j]} WHEN {d.has('_pa', P_OLD)} THEN {ol[j]} END")
    nw, od = VAGE_PRESETS["new"], VAGE_PRESETS["old"]
    for j, name in ((0, "vehicle_age_min"), (1, "vehicle_age_max")):
        e[name] = (f"CASE WHEN _has_vage THEN TRY_CAST({d.ext(p, P_VAGE, j + 1)} AS BIGINT) "
                   f"WHEN _has_new THEN {nw[j]} WHEN _has_oldcars THEN {od[j]} END")
    e["subscription_min"] = f"TRY_CAST({d.opt(p, P_SUB, 1)} AS BIGINT)"
    e["subscription_max"] = f"TRY_CAST({d.opt(p, P_SUB, 2)} AS BIGINT)"
    e["region_code"] = f"upper({d.opt(p, P_REGION, 1)})"
    r = RATE_PRESETS
    preset = (f"CASE WHEN {d.has(p, P_RATE0)} THEN {r['none']} WHEN {d.has(p, P_RATE1)} THEN {r['all']} "
              f"WHEN instr({p}, 'high risk') > 0 OR instr({p}, 'risky') > 0 THEN {r['high']} "
              f"WHEN instr({p}, 'low risk') > 0 OR instr({p}, 'safe') > 0 THEN {r['low']} END")
    e["claim_rate"] = f"TRY_CAST(coalesce(TRY_CAST({d.opt(p, P_RATE, 1)} AS DOUBLE) / 100.0, {preset}) AS DOUBLE)"
    return [s1, s2, s3, s4, s5, e]


def describe_expr(engine: str, f: dict[str, str]) -> str:
    """EX23: the parsed plan as one line, parts in a fixed order, 'Default settings' when empty."""
    d = Dialect(engine)
    fc = lambda k: f"({f[k]})"
    alloc_parts = d.map(f"split({fc('allocation')}, ',')" if d.spark else f"string_split({fc('allocation')}, ',')", "x",
                        "CASE " +
                        f"WHEN {d.at('split(x, ' + chr(39) + ':' + chr(39) + ')' if d.spark else 'string_split(x, ' + chr(39) + ':' + chr(39) + ')', '2')} = 'count' "
                        f"THEN concat({d.at('split(x, ' + chr(39) + ':' + chr(39) + ')' if d.spark else 'string_split(x, ' + chr(39) + ':' + chr(39) + ')', '3')}, ' ', {d.at('split(x, ' + chr(39) + ':' + chr(39) + ')' if d.spark else 'string_split(x, ' + chr(39) + ':' + chr(39) + ')', '1')}) "
                        f"WHEN {d.at('split(x, ' + chr(39) + ':' + chr(39) + ')' if d.spark else 'string_split(x, ' + chr(39) + ':' + chr(39) + ')', '2')} = 'percent' "
                        f"THEN concat({d.at('split(x, ' + chr(39) + ':' + chr(39) + ')' if d.spark else 'string_split(x, ' + chr(39) + ':' + chr(39) + ')', '3')}, '% ', {d.at('split(x, ' + chr(39) + ':' + chr(39) + ')' if d.spark else 'string_split(x, ' + chr(39) + ':' + chr(39) + ')', '1')}) "
                        f"ELSE concat('Only ', {d.at('split(x, ' + chr(39) + ':' + chr(39) + ')' if d.spark else 'string_split(x, ' + chr(39) + ':' + chr(39) + ')', '1')}) END")
    title = {col: lab for _, col, lab in SAFETY}
    on_lab = d.map(f"split({fc('safety_on')}, ',')" if d.spark else f"string_split({fc('safety_on')}, ',')", "x",
                   "CASE x " + " ".join(f"WHEN {d.s(c)} THEN {d.s(t)}" for c, t in title.items()) + " END")
    off_lab = d.map(f"split({fc('safety_off')}, ',')" if d.spark else f"string_split({fc('safety_off')}, ',')", "x",
                    "CASE x " + " ".join(f"WHEN {d.s(c)} THEN {d.s('No ' + t)}" for c, t in title.items()) + " END")
    parts = [
        f"CASE WHEN {fc('n_rows')} IS NOT NULL THEN concat({d.thousands(fc('n_rows'))}, ' rows') END",
        f"CASE WHEN {fc('allocation')} IS NOT NULL THEN {d.join(alloc_parts, ', ')} "
        f"WHEN {fc('model')} IS NOT NULL THEN concat('Model ', {fc('model')}) END",
        f"replace({fc('fuel_types')}, ',', ' / ')",
        f"CASE WHEN {fc('segment')} IS NOT NULL THEN concat('Segment ', {fc('segment')}) END",
        fc("transmission_type"),
        f"CASE WHEN {fc('steering_type')} IS NOT NULL THEN concat({fc('steering_type')}, ' steering') END",
        f"CASE WHEN {fc('rear_brakes_type')} IS NOT NULL THEN concat({fc('rear_brakes_type')}, ' brakes') END",
        f"CASE WHEN {fc('ncap_min')} IS NOT NULL THEN concat('NCAP >=', TRY_CAST({fc('ncap_min')} AS STRING)) END",
        f"CASE WHEN {fc('safety_on')} IS NOT NULL THEN {d.join(on_lab, ' | ')} END",
        f"CASE WHEN {fc('safety_off')} IS NOT NULL THEN {d.join(off_lab, ' | ')} END",
        f"CASE WHEN {fc('age_min')} IS NOT NULL THEN concat('Age ', TRY_CAST({fc('age_min')} AS STRING), '-', TRY_CAST({fc('age_max')} AS STRING)) END",
        f"CASE WHEN {fc('vehicle_age_min')} IS NOT NULL THEN concat('Vehicle age ', TRY_CAST({fc('vehicle_age_min')} AS STRING), '-', TRY_CAST({fc('vehicle_age_max')} AS STRING)) END",
        f"CASE WHEN {fc('subscription_min')} IS NOT NULL THEN concat('Subscription ', TRY_CAST({fc('subscription_min')} AS STRING), '-', TRY_CAST({fc('subscription_max')} AS STRING)) END",
        f"CASE WHEN {fc('region_code')} IS NOT NULL THEN concat('Region ', {fc('region_code')}) END",
        f"CASE WHEN {fc('exclude')} IS NOT NULL THEN concat('Exclude ', replace({fc('exclude')}, ',', ', ')) END",
        f"CASE WHEN {fc('rest')} IS NOT NULL AND {fc('rest')} <> 'distribute' THEN concat('Rest -> ', {fc('rest')}) END",
        f"CASE WHEN {fc('claim_rate')} IS NOT NULL THEN concat('Claim rate ', {d.fmt('%.0f%%', fc('claim_rate') + ' * 100')}) END",
    ]
    joined = d.join(d.filt(d.arr(*parts), "x", "x IS NOT NULL"), " | ")
    return f"coalesce(nullif({joined}, ''), 'Default settings')"


FIELDS = ["n_rows", "allocation", "exclude", "rest", "model", "fuel_types", "segment", "transmission_type",
          "steering_type", "rear_brakes_type", "safety_on", "safety_off", "ncap_min", "age_min", "age_max",
          "vehicle_age_min", "vehicle_age_max", "subscription_min", "subscription_max", "region_code", "claim_rate"]


def parse_requests(df: DataFrame, text_col: str = "prompt", keep: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """EX1-EX23 as a chain of narrow projections: every field plus the description line."""
    from tabletwin.session import dealt
    src = df if df.isStreaming else dealt(df)
    out = src.selectExpr(*keep, f"lower(trim({text_col})) AS p")
    carried = list(keep) + ["p"]
    for st in field_stages("spark"):
        out = out.selectExpr(*carried, *[f"{v} AS {k}" for k, v in st.items()])
        carried += list(st)
    return out.selectExpr(*keep, *FIELDS, f"{describe_expr('spark', {k: k for k in FIELDS})} AS description")


def parse_sql(src: str, text_col: str = "prompt", key: str = "request_id") -> str:
    """The same rules as one DuckDB SELECT over ``src``."""
    q = f"SELECT {key}, lower(trim({text_col})) AS p FROM {src}"
    for st in field_stages("duckdb"):
        q = f"SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in st.items()) + f" FROM ({q})"
    return (f"SELECT {key}, {', '.join(FIELDS)}, {describe_expr('duckdb', {k: k for k in FIELDS})} AS description FROM ({q})")
