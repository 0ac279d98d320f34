"""SQL fragments, for DuckDB, of what the column functions compute."""

from __future__ import annotations

BLANK = r"[\s\x{00a0}\x{200b}\x{feff}''\"`]*"


def cid(c: str) -> str:
    digits = rf"replace(regexp_extract({c}, '^{BLANK}(?:[A-Za-z]+[-_:#/]?)?([0-9][0-9-]*)(?:\.0*)?{BLANK}$', 1), '-', '')"
    expo = rf"cast(try_cast(try_cast(regexp_extract({c}, '^{BLANK}([0-9](?:\.[0-9]+)?[eE]\+?[0-9]{{1,2}}){BLANK}$', 1) as double) as decimal(20,0)) as varchar)"
    spelled = f"case when regexp_matches({c}, '[0-9][eE][+0-9]') then {expo} else {digits} end"
    fixed = rf"regexp_replace({spelled}, '^([0-9]{{2}})([0-9]{{8}})$', '\10\2')"
    return f"nullif(nullif(regexp_extract({fixed}, '^[0-9]{{11}}$'), ''), '00000000000')"


def secs(c: str) -> str:
    num = r"([0-9]+[.,]?[0-9]*(?:[eE][+-]?[0-9]+)?|[.,][0-9]+)"
    q = lambda unit: rf"try_cast(replace(regexp_extract({c}, '(?i)^{BLANK}\+?{BLANK}{num}{BLANK}{unit}{BLANK}$', 1), ',', '.') as double)"
    clock = rf"^{BLANK}(?:([0-9]+):)?([0-9]+):([0-9]{{1,2}}(?:[.,][0-9]+)?){BLANK}$"
    part = lambda i: f"try_cast(replace(regexp_extract({c}, '{clock}', {i}), ',', '.') as double)"
    v = f"coalesce({q('(?:s|secs?|seconds?)?')}, {part(3)} + {part(2)} * 60 + coalesce({part(1)}, 0) * 3600)"
    return f"(case when {v} > 0 then {v} end)"


def tidy(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+|[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+$', '', 'g')"


def blanks(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x{{00a0}}]+', ' ', 'g'))"


def num(c: str) -> str:
    v = rf"try_cast(regexp_replace({tidy(c)}, '^\+', '') as double)"
    return f"(case when not isnan({v}) then {v} end)"


def finite(c: str) -> str:
    return f"(case when isfinite({c}) then {c} end)"


def agent_text(c: str) -> str:
    t = blanks(c)
    for x in "abcdefghijklmnopqrstuvwxyz":
        t = rf"regexp_replace({t}, '([0-9]){x}([^\pL\pN_]|$)', '\1{x.upper()}\2', 'g')"
    core = r"regexp_replace(w, '[^\pL\pN_]+$', '')"
    tail = f"w[length({core}) + 1:]"
    shout = f"length({core}) > 1 and upper({core}) = {core} and lower({core}) != {core} and {core} != 'CMU'"
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: case when regexp_full_match({core}, '[0-9]+[a-zA-Z]') then upper({core}) || {tail} when {shout} then upper({core}[1]) || lower({core}[2:]) || {tail} else w end), ' ')"


def prompt(c: str) -> str:
    t = rf"regexp_replace(lower({c}), '[\s\x{{00a0}}]+([?.!,''\"])([\s\x{{00a0}}]|$)', '\1\2', 'g')"
    return rf"trim(regexp_replace({t}, '[\s\x{{00a0}}]+', ' ', 'g'))"


def first_key(c: str) -> str:
    """The first name behind the last opening mark left when closed groups are taken out, at most 32 in each other."""
    w = r"[\pL\pN_]+"
    t = rf"regexp_replace({c}, '({w})\[.*?\]', '\1', 'g')"
    for _ in range(32):
        t = rf"regexp_replace({t}, '\([^()]*\)', ' ', 'g')"
    return rf"case when lower({blanks(c)}) = 'semantic no match' then 'semantic_no_match' else regexp_extract(regexp_replace({t}, '(?s)^.*\(', ''), '{w}') end"


# Short answers.
RESPONSES = "'yeah', 'yes', 'yep', 'correct', 'wrong', 'huh', 'uh', 'okay', 'ok', 'right', 'alright', 'oh', 'sure', 'really', 'no', 'nope'"

LOG = "(select distinct on (log_id) * from system_features_full)"
AGENT = "(select distinct on (turn_id) * from validated_agent_transcript)"
USER = "(select distinct on (utt_id) * from validated_user_transcript)"
MS = lambda c: f"cast(round({finite(c)} * 1000) as bigint)"
