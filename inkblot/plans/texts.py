"""Texts derived from the given tables in which every rule has something to find.

Each is one SQL expression that Spark and the checking engine both understand.
"""

from __future__ import annotations

_K = "cast(c_custkey as varchar(20))"
_M = f"md5({_K})"


def _mod(n: int, times: int = 1) -> str:
    return f"cast((c_custkey*{times}) % {n} as varchar(20))"


# A log line for each customer.
LOG_LINE = f"""concat(
 '[INFO] user=u', {_K}, ' user ''bob.', {_K}, ''' from 10.', {_mod(256)}, '.',
 {_mod(256, 7)}, '.9 key AKIA', upper(substr({_M},1,16)),
 ' for ''bkt-', {_K}, ''' s3://data-', {_K}, ' Bearer ', {_M}, ' token=', substr({_M},1,12),
 ' sk_live_', substr({_M},1,24), ' zip ', lpad({_mod(100000)},5,'0'),
 ' at ', lpad({_mod(100000)},5,'0'), ' Main Street, ssn 123-45-',
 lpad({_mod(10000)},4,'0'), ' call 212-555-', lpad({_mod(10000)},4,'0'),
 ' user: a', {_K}, '@x.example.com card 4111-1111-1111-', lpad({_mod(10000)},4,'0'),
 ' fe80::', substr({_M},1,4), ' by ', c_name)"""

# A small Python source for each customer.
SOURCE = f"""concat(
 'api_key = "', {_M}, '"', chr(10), 'name = "x"', chr(10),
 'cfg[''password''] = ''pw-', {_K}, '''', chr(10),
 'd = {{"secret_token": "s-', {_K}, '", "port": "80"}}', chr(10),
 'print("pw-', {_K}, '")', chr(10), 'old_pwd = "pw-', {_K}, '"', chr(10))"""

_O = "cast(event_id % 256 as varchar(20))"
_U = "cast(user_id as varchar(20))"

# Strings of a record for each event, in the order of its leaves.
LEAVES = (
    f"concat('10.1.', {_O}, '.9')",
    f"concat('zip ', lpad(cast(event_id % 100000 as varchar(20)),5,'0'), ' from 10.2.', {_O}, '.7 and 10.2.', {_O}, '.8')",
    f"concat('user=u', {_U})",
    f"concat('10.3.3.', {_O})",
)
JSON_RECORD = f"""concat('{{"id": ', {_O}, ', "src": "', {LEAVES[0]}, '", "note": "', {LEAVES[1]},
 '", "tags": ["', {LEAVES[2]}, '", {{"at": "', {LEAVES[3]}, '"}}], "props": ', props, ', "10.9.9.9": true}}')"""
CSV_RECORD = f"""concat('10.0.0.1,note', chr(13), chr(10), {LEAVES[0]}, ',"', {LEAVES[1]}, ', ', {LEAVES[2]}, '"', chr(13), chr(10))"""
XML_RECORD = f"""concat('<r a="', {LEAVES[0]}, '"><!-- x --><b>', {LEAVES[1]}, '</b>tail ', {LEAVES[3]}, '</r>')"""
TABLE_NOTE = "concat('zip ', lpad(cast(c_custkey % 100000 as varchar(20)), 5, '0'), ' seen at 10.0.', cast(c_custkey % 256 as varchar(20)), '.1 and 10.0.', cast(c_custkey % 256 as varchar(20)), '.2')"
TABLE_ADDR = "concat('10.7.', cast(c_custkey % 256 as varchar(20)), '.3')"
RECORD_TEXT = "concat('from 10.0.', cast(event_id % 256 as varchar(20)), '.1 by user=u', cast(user_id as varchar(20)))"
PLACE_TEXT = """concat(c_name, ' lives in ', n_name, ' ', r_name, ', not in ', r_name, '.')"""
# The second half of a page's address decides its path; a page without one is plain text.
PAGE_PATH = """concat(regexp_replace(split_part(url, '?', 1), '#.*$', ''), case page_id % 5 when 0 then '/a.PY' when 1 then '/b.json' when 2 then '/c.js' else '' end)"""
# Addresses with long local parts, behind letters and marks that do not belong to them.
LONG_MAIL = f"""concat('write to ', repeat('ab.', cast(c_custkey % 60 as int)), repeat('x', cast(30 + c_custkey % 90 as int)), '@mail.example.org, not to (', '--.a', {_K}, '@x.example.com or to ', 'é', repeat('y', cast(c_custkey % 70 as int)), '.z@y.example.net')"""
# Rows of different length, some without a cell.
RAGGED = f"""concat('10.0.', {_mod(256)}, '.1,b', repeat(',10.1.', 1), {_mod(256)}, '.2', chr(10), chr(10), 'x,y', chr(10), 'user=u', {_K}, ',"10.2.', {_mod(256)}, '.3, z",,10.3.', {_mod(256)}, '.4', chr(10))"""
# Sources whose indented text parses only when dedented, and whose literals are not spelled as they read.
EDGED = f"""concat('  password = "', substr({_M}, 1, 24), chr(92), 'n', substr({_M}, 5, 24), '"', chr(10), '  x = 1', chr(10))"""
PEOPLE_TEXT = "concat(c_name, ' of ', c_mktsegment, ' wrote')"
# A line of a CSV file whose second cell goes over a line feed and holds quotes.
CSV_LINE = f"""concat({_K}, ',"', c_name, chr(10), 'says ""', c_mktsegment, '"", once",10.0.', {_mod(256)}, '.1')"""
# What a file for each supplier holds.
FILE_TEXT = """concat(s_name, ' of 10.0.0.', cast(s_suppkey % 256 as varchar(20)), chr(13), 'user=u', cast(s_suppkey as varchar(20)))"""
