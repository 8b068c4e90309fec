"""For each registered query, the same result in SQL for the checking engine.

That engine's regular expressions have no look-around: rules that look ahead or behind are matched
with what they look at, which is then cut off, or as maximal runs of which some are kept.
"""

from __future__ import annotations

import re

from inkblot.plans.texts import (
    EDGED, FILE_TEXT, JSON_RECORD, LEAVES, LOG_LINE, LONG_MAIL, PAGE_PATH, PLACE_TEXT, RAGGED, RECORD_TEXT, SOURCE, TABLE_ADDR, TABLE_NOTE,
)
from inkblot.rules import CODE_PATTERNS, DEFAULT_WEIGHT, DOC_ENTITIES, DOC_PATTERNS, ENTITY_PATTERNS, PRIORITIES, SUSPICIOUS_NAMES, WEIGHTS

FIRST_LOG_ID = 1_000_000_000

LOGS = f"(select c_custkey as doc_id, {LOG_LINE} as text from customer)"
SOURCES = f"(select c_custkey as doc_id, {SOURCE} as text from customer)"
DOCUMENTS = "(select doc_id, text from documents)"
MIXED = f"(select doc_id, text from documents union all select {FIRST_LOG_ID} + doc_id, text from {LOGS})"
CODE = f"(select doc_id, text from {SOURCES} union all select {FIRST_LOG_ID} + doc_id, text from {LOGS})"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _looked_at(pattern: str) -> str:
    """A rule with what it looks at before and after made part of the match."""
    return re.sub(r"\(\?<?=((?:[^()\\]|\\.)*)\)", r"\1", pattern)


# What precedes and follows the finding in a match of a rule that looks around.
AROUND = {
    "S3_BUCKET": (r"""^(?:s3://|bucket\s['"]|for\s')""", r"""['"]$"""), "GENERIC_TOKEN": ("^token=", ""),
    "USERNAME": (r"""^user(?:\s['"]|:\s|=)""", r"""['"]$"""),
}
RULES = CODE_PATTERNS | DOC_PATTERNS | ENTITY_PATTERNS | {"HEX_SECRET": r"\b[0-9a-f]{40}\b"}
PATTERNS: dict[str, tuple[str, str, str]] = {label: (_looked_at(p) if label in AROUND else p, *AROUND.get(label, ("", ""))) for label, p in RULES.items()}
# rules whose look-ahead only turns positions down, and one that keeps runs of a certain length
PATTERNS["PHONE_NUMBER"] = (RULES["PHONE_NUMBER"].removeprefix(r"(?=[+(\d])"), "", "")
PATTERNS["IP_ADDRESS"] = (RULES["IP_ADDRESS"].removeprefix("(?=[0-9a-fA-F]{1,4}[.:])"), "", "")
PATTERNS["AWS_KEY"] = ("[A-Z0-9]+", "", "")
DOC_RULES = (*DOC_PATTERNS, *(e for e in DOC_ENTITIES if e in ENTITY_PATTERNS))
PRIORITY = PRIORITIES
WEIGHT = WEIGHTS | {"HEX_SECRET": 45}
TOKEN = r"""[^\s"'(){}\[\]=,;:\\]"""


def matches(source: str, pattern: str, before: str = "", after: str = "", where: str = "true") -> str:
    """``doc_id, s, e, snippet`` of every match: sizes of matches and of the texts between, summed."""
    p = lit(pattern)
    head = f"regexp_replace(m, {lit(before)}, '')" if before else "m"
    body = f"regexp_replace({head}, {lit(after)}, '')" if after else head
    return f"""(select doc_id, s0 + length(m) - length({head}) as s, s0 + length(m) - length({head}) + length({body}) as e,
  {body} as snippet from (
   select doc_id, ms[i] as m, coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)
     + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as s0
   from (select doc_id, ms, gs, unnest(range(1, len(ms) + 1)) as i
         from (select doc_id, regexp_extract_all(text, {p}) as ms, string_split_regex(text, {p}) as gs from {source}))
  ) where {where})"""


def rule(source: str, label: str) -> str:
    pattern, before, after = PATTERNS[label]
    return matches(source, pattern, before, after, "length(m) = 20" if label == "AWS_KEY" else "true")


def entropy_of(tokens: str) -> str:
    """Distinct tokens of ``tokens(snippet)`` with their entropy, ``h``."""
    return f"""(select snippet, sum(case when unicode(c) < 256 then -(n / length(snippet)) * log2(n / length(snippet)) else 0 end) as h
  from (select snippet, c, count(*)::double as n
        from (select snippet, unnest(string_split(snippet, '')) as c from (select distinct snippet from {tokens}))
        group by all) group by snippet)"""


def high_entropy(source: str) -> str:
    tokens = matches(source, TOKEN + "+", where="length(m) >= 8 and not regexp_matches(m, '^[a-zA-Z_]+$')")
    return f"(select doc_id, s, e, t.snippet, h from {tokens} t join {entropy_of(tokens)} h on t.snippet = h.snippet where h > 3.2)"


SITE_PATTERNS = {
    "name": r"""(?m)^[ \t]*([A-Za-z_][A-Za-z0-9_]*)[ \t]*=[ \t]*(?:"([^"\\\n]+)"|'([^'\\\n]+)')""",
    "subscript": r"""\[[ \t]*["']([^"'\\\n]+)["'][ \t]*\][ \t]*=[ \t]*(?:"([^"\\\n]+)"|'([^'\\\n]+)')""",
    "dict": r"""[{,][ \t]*["']([^"'\\\n]+)["'][ \t]*:[ \t]*(?:"([^"\\\n]+)"|'([^'\\\n]+)')""",
}
SUSPICIOUS = "|".join(SUSPICIOUS_NAMES)


def sites(source: str) -> str:
    parts = [
        f"""select doc_id, {lit(form)} as form, regexp_extract(m, {lit(p)}, 1) as name,
   concat(coalesce(regexp_extract(m, {lit(p)}, 2), ''), coalesce(regexp_extract(m, {lit(p)}, 3), '')) as literal
  from (select doc_id, unnest(regexp_extract_all(text, {lit(p)})) as m from {source})"""
        for form, p in SITE_PATTERNS.items()
    ]
    return f"(select * from ({' union all '.join(parts)}) where regexp_matches(lower(name), '{SUSPICIOUS}'))"


def assigned(source: str) -> str:
    return f"""(select doc_id, s, s + length(literal) as e, literal as snippet, copies from (
   select doc_id, literal, copies, list_sum(list_transform(gs[1:i], lambda x: length(x))) + (i - 1) * length(literal) as s
   from (select doc_id, literal, copies, gs, unnest(range(1, len(gs))) as i from (
     select d.doc_id, literal, copies, string_split(text, literal) as gs from {source} d
     join (select doc_id, literal, count(*) as copies from {sites(source)} group by all) l on d.doc_id = l.doc_id))))"""


def doc_findings(source: str, extra: str = "") -> str:
    parts = [
        f"select doc_id, s, e, snippet, {lit(label)} as label, {i} as ro, 0 as prio, {WEIGHT.get(label, DEFAULT_WEIGHT)} as weight, 1 as copies from {rule(source, label)}"
        for i, label in enumerate(DOC_RULES)
    ]
    return "(" + " union all ".join(parts) + extra + ")"


def code_findings(source: str) -> str:
    found = [(label, rule(source, label), "1") for label in ("EMAIL_ADDRESS", "AWS_KEY", "IPV4", "IPV6")]
    found += [("HIGH_ENTROPY_SECRET", high_entropy(source), "1"), ("SECRET_VAR_ASSIGNMENT", assigned(source), "copies")]
    parts = [
        f"select doc_id, s, e, snippet, {lit(label)} as label, {i} as ro, {PRIORITY[label]} as prio, {WEIGHT.get(label, DEFAULT_WEIGHT)} as weight, {copies} as copies from {sql}"
        for i, (label, sql, copies) in enumerate(found)
    ]
    return "(" + " union all ".join(parts) + ")"


def kept_cte(findings: str, scope: str = "doc_id") -> str:
    """``kept``: findings left when overlaps are resolved, with ``n``, by a walk along each document.

    Numbers run on through the documents of a ``scope``.
    """
    return f"""with recursive numbered as materialized (
  select *, row_number() over (partition by doc_id order by s desc, prio desc, ro, e) as k from {findings}),
 walk as (
  select *, true as keep, s as frontier from numbered where k = 1
  union all
  select n.*, n.e <= w.frontier, case when n.e <= w.frontier then n.s else w.frontier end
  from walk w join numbered n on n.doc_id = w.doc_id and n.k = w.k + 1),
 kept as (select doc_id, s, e, label, snippet, row_number() over (partition by {scope}, label order by doc_id, s desc) as n
          from walk where keep)"""


def rewritten(source: str) -> str:
    """``doc_id, text`` with placeholders; needs ``kept`` in scope."""
    return f"""(select d.doc_id, coalesce(p.head || substr(d.text, (p.last + 1)::bigint), d.text) as text from {source} d left join (
  select doc_id, max(e) as last, string_agg(piece, '' order by s) as head from (
    select k.doc_id, k.s, k.e, substr(t.text, (prev + 1)::bigint, (k.s - prev)::bigint) || '<' || label || '_' || n || '>' as piece
    from (select *, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from kept) k
    join {source} t on t.doc_id = k.doc_id)
  group by doc_id) p on p.doc_id = d.doc_id)"""


BAND = "case when score = 0 then 'SAFE' when score < 20 then 'LOW' when score < 50 then 'MEDIUM' when score < 100 then 'HIGH' else 'CRITICAL' end"


def risk(source: str, findings: str) -> str:
    return f"""(select doc_id, n_findings, score, {BAND} as band, score > 50 as alert from (
  select d.doc_id, coalesce(n, 0)::bigint as n_findings, coalesce(w, 0)::bigint as score from {source} d left join (
   select doc_id, sum(copies) as n, sum(weight * copies) as w from {findings} group by doc_id) f on f.doc_id = d.doc_id))"""


def _spans(sql: str) -> str:
    return f"select doc_id, s::int as start_at, e::int as end_at, snippet from {sql}"


def _listing(findings: str, order: str) -> str:
    return f"""select doc_id, (row_number() over (partition by doc_id order by {order}) - 1)::int as ord, label,
  s::int as start_at, e::int as end_at, snippet from {findings}"""


NAME_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_#'’&.-]*[\p{L}\p{N}_])?"
PLACES = """(select lower(n_name) as key from nation union select lower(r_name) from region
 union select lower(n_name || ' ' || r_name) from nation join region on n_regionkey = r_regionkey)"""
PLACE_TEXTS = f"""(select c_custkey as doc_id, {PLACE_TEXT} as text from customer
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
PEOPLE_TEXTS = "(select c_custkey as doc_id, concat(c_name, ' of ', c_mktsegment, ' wrote') as text from customer)"


def named(source: str, keys: str) -> str:
    """Runs of one to three words, one blank apart, that are keys."""
    words = matches(source, NAME_WORD)
    runs = f"""select doc_id, s, e, snippet, lead(s) over o as s2, lead(e) over o as e2, lead(snippet) over o as w2,
   lead(s, 2) over o as s3, lead(e, 2) over o as e3, lead(snippet, 2) over o as w3
  from {words} window o as (partition by doc_id order by s)"""
    return f"""(select g.doc_id, g.s, g.e, g.snippet from (
  select doc_id, s, e, snippet from ({runs})
  union all select doc_id, s, e2, snippet || ' ' || w2 from ({runs}) where s2 = e + 1
  union all select doc_id, s, e3, snippet || ' ' || w2 || ' ' || w3 from ({runs}) where s2 = e + 1 and s3 = e2 + 1
 ) g join {keys} k on lower(g.snippet) = k.key)"""


# A document of several leaves has the ids from this many times its own on.
LEAF_IDS = 64


def _leaf_source(leaves: tuple[str, ...] = LEAVES, table: str = "events", key: str = "event_id") -> str:
    return "(" + " union all ".join(f"select {key} * {LEAF_IDS} + {i} as doc_id, {leaf} as text from {table}" for i, leaf in enumerate(leaves)) + ")"


def scrubbed_leaves(leaves: tuple[str, ...] = LEAVES, table: str = "events", key: str = "event_id") -> str:
    """``id, l0, l1, ..``: the leaves of each record scrubbed as those of one document."""
    source = _leaf_source(leaves, table, key)
    columns = ", ".join(f"max(text) filter (doc_id % {LEAF_IDS} = {i}) as l{i}" for i in range(len(leaves)))
    return f"""({kept_cte(doc_findings(source), f"doc_id // {LEAF_IDS}")} select doc_id // {LEAF_IDS} as id, {columns} from {rewritten(source)} group by 1)"""


def _json_text(id_of: str = "event_id") -> str:
    """A record as written with two blanks of indent, from its scrubbed leaves and the rest of the row."""
    lines = (
        "'{'", "concat('  \"id\": ', cast(event_id % 256 as varchar), ',')", "concat('  \"src\": \"', l0, '\",')", "concat('  \"note\": \"', l1, '\",')",
        "'  \"tags\": ['", "concat('    \"', l2, '\",')", "'    {'", "concat('      \"at\": \"', l3, '\"')", "'    }'", "'  ],'", "'  \"props\": {'",
        "concat('    \"k\": ', regexp_extract(props, '-?[0-9]+'))", "'  },'", "'  \"10.9.9.9\": true'", "'}'",
    )
    return f"concat_ws(chr(10), {', '.join(lines)})"


CSV_LEAVES = ("'10.0.0.1'", "'note'", LEAVES[0], f"concat({LEAVES[1]}, ', ', {LEAVES[2]})")
CSV_TEXT = "concat(l0, ',', l1, chr(13), chr(10), l2, ',\"', l3, '\"', chr(13), chr(10))"
XML_LEAVES = (LEAVES[0], LEAVES[1], f"concat('tail ', {LEAVES[3]})")


def _in_xml(leaf: str) -> str:
    return f"replace(replace({leaf}, '<', '&lt;'), '>', '&gt;')"


XML_TEXT = f"concat('<r a=\"', {_in_xml('l0')}, '\"><b>', {_in_xml('l1')}, '</b>', {_in_xml('l2')}, '</r>')"
_RAGGED_LEAVES = tuple(
    f"split_part(regexp_extract_all({RAGGED}, '[^\\n]+')[{row}], ',', {cell})" for row, cells in ((1, 3), (2, 2), (3, 1)) for cell in range(1, cells + 1)
) + (f"regexp_extract({RAGGED}, '\"([^\"]*)\"', 1)", "''", f"regexp_extract({RAGGED}, ',,([^\\n]*)', 1)")
_RAGGED_TEXT = "concat(l0, ',', l1, ',', l2, chr(13), chr(10), chr(13), chr(10), l3, ',', l4, chr(13), chr(10), l5, ',\"', l6, '\",', l7, ',', l8, chr(13), chr(10))"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["assemble_pages"] = "select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id"
    name = f"regexp_extract({PAGE_PATH}, '[^/]*$')"
    ext = f"lower(regexp_extract({name}, '^\\.*[^.].*?\\.([^.]*)$', 1))"
    q["route_kind"] = f"""select page_id, case when ext = 'py' then 'CODE' else 'DOC' end as kind, case when ext in ('js', 'ts', 'yaml', 'yml') then 'txt' else ext end as fmt
 from (select page_id, {ext} as ext from pages)"""
    for key, label, source in (
        ("find_ipv4", "IPV4", DOCUMENTS), ("find_ipv6", "IPV6", LOGS), ("find_bearer", "AUTH_BEARER", LOGS),
        ("find_aws_key", "AWS_KEY", MIXED), ("find_s3", "S3_BUCKET", LOGS), ("find_stripe", "STRIPE_KEY", LOGS),
        ("find_card", "CREDIT_CARD_REGEX", DOCUMENTS), ("find_zip", "US_ZIP", MIXED), ("find_street", "STREET_ADDRESS", LOGS),
        ("find_token", "GENERIC_TOKEN", LOGS), ("find_user", "USERNAME", LOGS), ("find_email", "EMAIL_ADDRESS", MIXED),
        ("find_phone", "PHONE_NUMBER", MIXED), ("find_ssn", "US_SSN", LOGS), ("find_ip_entity", "IP_ADDRESS", MIXED),
    ):
        q[key] = _spans(rule(source, label))
    hexed = (
        f" union all select doc_id, s, e, snippet, 'HEX_SECRET', {len(DOC_RULES)}, 0, 45, 1 from {rule(DOCUMENTS, 'HEX_SECRET')}"
    )
    q["custom_rule"] = f"select doc_id, label, s::int as start_at, e::int as end_at, snippet, weight from {doc_findings(DOCUMENTS, hexed)}"
    buckets = matches(LOGS, "bkt-[0-9]+")
    q["custom_rules_many"] = f"""select doc_id, 'R' || substr(snippet, 5) as label, s::int as start_at, e::int as end_at, snippet, (substr(snippet, 5)::int % 60) as weight
 from {buckets} where try_cast(substr(snippet, 5) as bigint) < 20000 and (snippet = 'bkt-0' or substr(snippet, 5, 1) <> '0')"""
    q["entropy_tokens"] = _spans(matches(DOCUMENTS, TOKEN + "+"))
    long_tokens = matches(DOCUMENTS, TOKEN + "+", where="length(m) >= 8 and not regexp_matches(m, '^[a-zA-Z_]+$')")
    q["token_entropy"] = f"select snippet as token, round(h, 6) as entropy from {entropy_of(long_tokens)}"
    q["find_entropy"] = _spans(high_entropy(DOCUMENTS))
    q["assign_sites"] = f"select * from {sites(SOURCES)}"
    q["find_assign"] = f"select doc_id, s::int as start_at, e::int as end_at, snippet, copies::int as copies from {assigned(SOURCES)}"
    q["find_person"] = _spans(named(LOGS, "(select distinct lower(c_name) as key from customer)"))
    q["find_person_join"] = q["find_person"]
    q["find_model_entity"] = q["find_person"]
    q["find_location"] = _spans(named(PLACE_TEXTS, PLACES))
    people = "(select lower(c_name) as key from customer union select lower(c_mktsegment) from customer)"
    q["person_filter"] = (
        f"select doc_id, s::int as start_at, snippet, not regexp_matches(snippet, '[_0-9]') as kept from {named(PEOPLE_TEXTS, people)}"
    )
    q["assign_sites_native"] = q["assign_sites"]
    q["scan_code"] = f"select doc_id, label, s::int as start_at, e::int as end_at, snippet, prio::int as priority, copies::int as copies from {code_findings(CODE)}"
    q["scan_doc"] = f"select doc_id, label, s::int as start_at, e::int as end_at, snippet from {doc_findings(MIXED)}"
    allow = "(select concat('u', cast(s_suppkey as varchar(20))) as value from supplier union select concat('a', cast(s_suppkey as varchar(20))) from supplier)"
    q["allow_list"] = f"select doc_id, label, s::int as start_at, snippet from {doc_findings(MIXED)} f where not exists (select 1 from {allow} a where a.value = f.snippet)"
    q["allow_list_join"] = q["allow_list"]
    q["order_code"] = _listing(code_findings(CODE), "s desc, prio desc, ro, e")
    q["order_doc"] = _listing(doc_findings(MIXED), "s, ro")
    q["findings_json"] = q["order_doc"]
    q["resolve_code"] = f"{kept_cte(code_findings(CODE))} select doc_id, s::int as start_at, e::int as end_at, label from kept"
    q["resolve_doc"] = f"{kept_cte(doc_findings(MIXED))} select doc_id, s::int as start_at, e::int as end_at, label from kept"
    q["resolve_islands"], q["scan_code_native"] = q["resolve_doc"], q["scan_code"]
    q["placeholders"] = f"{kept_cte(doc_findings(MIXED))} select doc_id, s::int as start_at, '<' || label || '_' || n || '>' as placeholder from kept"
    q["vault"] = f"{kept_cte(doc_findings(MIXED))} select doc_id, '<' || label || '_' || n || '>' as placeholder, label, n::int as n, snippet as original from kept"
    q["scrub_text"] = f"{kept_cte(doc_findings(MIXED))} select doc_id, text, 'DOC' as engine from {rewritten(MIXED)}"
    q["scrub_islands"] = q["scrub_text"]
    q["scrub_code"] = f"{kept_cte(code_findings(CODE))} select doc_id, text, 'CODE' as engine from {rewritten(CODE)}"
    q["scrub_one_way"] = f"{kept_cte(doc_findings(MIXED))} select doc_id, text from {rewritten(MIXED)}"
    q["restore"] = f"select doc_id, text from {MIXED}"
    q["restore_map"] = q["publish_vault"] = q["restore"]
    q["stream_restore"] = f"select doc_id, text from {DOCUMENTS}"
    q["roundtrip_violations"] = (
        f"select count(*) as n_docs, count(*) filter (where regexp_matches(text, '<[^<>]+_[0-9]+>')) as n_flagged, 0::bigint as n_violations from {MIXED}"
    )
    leaf_rules = " union all ".join(
        f"select doc_id // {LEAF_IDS} as doc_id, (doc_id % {LEAF_IDS})::int as leaf, s, e, {lit(label)} as label, snippet from {rule(_leaf_source(), label)}"
        for label in ("IPV4", "US_ZIP", "USERNAME")
    )
    q["leaf_scan"] = f"""select doc_id, leaf, s::int as start_at, label, snippet,
 '<' || label || '_' || row_number() over (partition by doc_id, label order by leaf, s desc) || '>' as placeholder from ({leaf_rules})"""
    four = scrubbed_leaves()
    q["scrub_json"] = f"select event_id as doc_id, {_json_text()} as text, l0 as src, l1 as note, l2 as who, l3 as seen_at from events join {four} on id = event_id"
    q["scrub_csv"] = f"select id as doc_id, {CSV_TEXT} as text from {scrubbed_leaves(CSV_LEAVES)}"
    q["scrub_xml"] = f"select id as doc_id, {XML_TEXT} as text from {scrubbed_leaves(XML_LEAVES)}"
    broken = f"(select event_id as doc_id, left(text, length(text) - 1) as text from (select event_id, {JSON_RECORD} as text from events))"
    q["json_fallback"] = f"{kept_cte(doc_findings(broken))} select doc_id, true as fallback, text from {rewritten(broken)}"
    q["scrub_columns"] = f"select event_id as doc_id, l0 as src, l1 as note, l2 as who, l3 as seen_at, event_type as kept from events join {four} on id = event_id"
    wide = tuple(LEAVES[i % 4] for i in range(18)) + (LEAVES[2], LEAVES[0]) + tuple(LEAVES[i % 4] for i in range(20))
    q["scrub_wide"] = f"select id as doc_id, concat_ws('|', {', '.join(f'l{i}' for i in range(40))}) as text from {scrubbed_leaves(wide)}"
    q["csv_ragged"] = f"select id as doc_id, {_RAGGED_TEXT} as text from {scrubbed_leaves(_RAGGED_LEAVES, 'customer', 'c_custkey')}"
    whole = [
        f"select doc_id, text, 'CODE' as engine from ({kept_cte(code_findings(SOURCES))} select * from {rewritten(SOURCES)})",
        f"select doc_id + {FIRST_LOG_ID}, text, 'DOC' from ({kept_cte(doc_findings(LOGS))} select * from {rewritten(LOGS)})",
        f"select event_id + {2 * FIRST_LOG_ID}, {_json_text()}, 'DOC' from events join {four} on id = event_id",
        f"select id + {3 * FIRST_LOG_ID}, {CSV_TEXT}, 'DOC' from {scrubbed_leaves(CSV_LEAVES)}",
        f"select id + {4 * FIRST_LOG_ID}, {XML_TEXT}, 'DOC' from {scrubbed_leaves(XML_LEAVES)}",
    ]
    q["scrub_any"] = " union all ".join(whole)
    listed = "(select 0 as first, 0 as leaf, label, s, e, snippet, doc_id, copies from " + code_findings(SOURCES) + ")"
    parts = [f"select doc_id, 0 as leaf, label, s::int as start_at, e::int as end_at, snippet from {listed}"]
    parts.append(f"select doc_id + {FIRST_LOG_ID}, 0, label, s::int, e::int, snippet from {doc_findings(LOGS)}")
    for i, leaves in ((2, LEAVES), (3, CSV_LEAVES), (4, XML_LEAVES)):
        parts.append(f"select doc_id // {LEAF_IDS} + {i * FIRST_LOG_ID}, (doc_id % {LEAF_IDS})::int, label, s::int, e::int, snippet from {doc_findings(_leaf_source(leaves))}")
    q["scan_any"] = " union all ".join(parts)
    mail = f"(select c_custkey as doc_id, c_custkey % 70 as more, {LONG_MAIL} as text from customer)"
    q["find_email_long"] = f"""select doc_id, s::int as start_at, (s + length(snippet))::int as end_at, snippet from (
  select doc_id, 9 as s, regexp_extract(text, '^write to ([^@]*@mail.example.org)', 1) as snippet from {mail}
  union all select doc_id, strpos(text, '--.a') + 2, regexp_extract(text, '--.(a[0-9]+@x.example.com)', 1) from {mail}
  union all select doc_id, strpos(text, ' é') + 1 + more, '.z@y.example.net' from {mail})"""
    five = """(select lower(concat_ws(' ', n_name, r_name, n_name)) as key, n_regionkey, n_nationkey from nation join region on n_regionkey = r_regionkey
 union all select lower(concat('lives in ', n_name, ' ', r_name)), n_regionkey, n_nationkey from nation join region on n_regionkey = r_regionkey)"""
    q["find_location_long"] = f"""select doc_id, (strpos(lower(text), key) - 1)::int as start_at, (strpos(lower(text), key) - 1 + length(key))::int as end_at,
  substr(text, strpos(lower(text), key)::bigint, length(key)) as snippet from {PLACE_TEXTS} join {five} on contains(lower(text), key || ',')"""
    q["allow_list_scan"] = f"""select doc_id, label, s::int as start_at, snippet from {doc_findings(LOGS)} f where not exists (select 1 from {allow} a where a.value = f.snippet)
  and not (regexp_full_match(snippet, 'u[0-9]+') and try_cast(substr(snippet, 2) as bigint) < 20000 and (snippet = 'u0' or substr(snippet, 2, 1) <> '0'))"""
    edged = f"(select c_custkey as doc_id, md5(cast(c_custkey as varchar(20))) as m, {EDGED} as text from customer)"
    q["find_edges"] = f"""select doc_id, b::int as start_at, (b + t + 19)::int as end_at, substr(text, (b + 1)::bigint, (t + 19)::bigint) as snippet from (
  select *, strpos(substr(text, (b + 1)::bigint), substr(m, 9, 20)) as t from (select *, strpos(text, substr(m, 1, 20)) - 1 as b from {edged}))"""
    q["csv_file"] = """select c_custkey as doc_id, concat(c_name, chr(10), 'says "', c_mktsegment, '", once') as note,
 concat('10.0.', cast(c_custkey % 256 as varchar), '.1') as addr, 3::int as n from customer"""
    q["read_files"] = f"""select s_suppkey, 'DOC' as kind, 'txt' as fmt, concat(regexp_replace(replace(replace(t, ip, '<IPV4_1>'), chr(13), chr(10)), 'user=.*$', 'user=<USERNAME_1>'), chr(10)) as text,
 null::varchar as error from (select s_suppkey, {FILE_TEXT} as t, concat('10.0.0.', cast(s_suppkey % 256 as varchar)) as ip from supplier)"""
    q["restore_dup"] = f"select doc_id, text from {LOGS}"
    both = f"(select c_custkey * 2 as doc_id, {TABLE_NOTE} as text from customer union all select c_custkey * 2 + 1, {TABLE_ADDR} from customer)"
    lines = " union all ".join(f"select doc_id, s, {lit(label)} as label from {rule(both, label)}" for label in ("IPV4", "US_ZIP"))
    q["scrub_table"] = f"""with f as (select doc_id, s, label,
  '<' || label || '_' || row_number() over (partition by label order by doc_id, s desc) || '>' as p from ({lines}))
 select c_custkey, concat('zip ', z.p, ' seen at ', a.p, ' and ', b.p) as note, c.p as addr from customer
 join f z on z.doc_id = c_custkey * 2 and z.label = 'US_ZIP'
 join (select doc_id, p, row_number() over (partition by doc_id order by s) as r from f where label = 'IPV4') a on a.doc_id = c_custkey * 2 and a.r = 1
 join (select doc_id, p, row_number() over (partition by doc_id order by s) as r from f where label = 'IPV4') b on b.doc_id = c_custkey * 2 and b.r = 2
 join f c on c.doc_id = c_custkey * 2 + 1 and c.label = 'IPV4'"""
    q["risk_score"] = f"select doc_id, n_findings, score from {risk(MIXED, doc_findings(MIXED))}"
    q["risk_band"] = f"select doc_id, score, band, alert from {risk(MIXED, doc_findings(MIXED))}"
    q["risk_code"] = f"select doc_id, n_findings, score, band, alert from {risk(CODE, code_findings(CODE))}"
    q["top_findings"] = f"""select doc_id, rnk::int as rank, label,
 case when length(t) > 27 then substr(t, 1, 27) || '...' else t end as snippet, greatest(n - 10, 0)::bigint as more from (
  select doc_id, label, trim(replace(snippet, chr(10), ' ')) as t, row_number() over (partition by doc_id order by s, ro) as rnk,
   count(*) over (partition by doc_id) as n from {doc_findings(MIXED)}) where rnk <= 10"""
    q["risk_by_source"] = f"""select source, count(*) as n_docs, sum(score)::bigint as score, max(score)::bigint as worst
 from {risk(DOCUMENTS, doc_findings(DOCUMENTS))} r join documents d on d.doc_id = r.doc_id group by source"""
    q["label_rollup"] = f"""select kind, label, sum(copies)::bigint as n from (
  select 'DOC' as kind, label, copies from {doc_findings(MIXED)} union all select 'CODE', label, copies from {code_findings(SOURCES)})
 group by rollup (kind, label)"""
    q["stream_scrub"] = f"{kept_cte(doc_findings(DOCUMENTS))} select doc_id, text from {rewritten(DOCUMENTS)}"
    rated = f"(select event_id as doc_id, {RECORD_TEXT} as text from events)"
    q["stream_risk"] = f"""select date_trunc('hour', ts) as window_start, count(*)::bigint as n_records, sum(n_findings)::bigint as n_findings, sum(score)::bigint as score
 from events join {risk(rated, doc_findings(rated))} r on r.doc_id = event_id group by 1"""
    return q
