"""Plain Python counterparts that work on one text at a time, to compare the row expressions with."""

from __future__ import annotations

import bisect
import csv
import io
import json
import math
import re
import xml.sax.handler
import xml.sax.saxutils
from collections import Counter
from itertools import chain

from inkblot import rules as R

TOKEN = re.compile(r"""[^\s"'(){}\[\]=,;:\\]{8,}""")


def pattern_findings(text, patterns):
    return [(m.start(), m.end(), label, m.group()) for label, p in patterns for m in re.finditer(p, text)]


def doc_patterns(custom=()):
    patterns = dict(R.DOC_PATTERNS)
    patterns.update(custom)
    return [*patterns.items(), *((e, R.ENTITY_PATTERNS[e]) for e in R.DOC_ENTITIES if e in R.ENTITY_PATTERNS)]


def entropy(token):
    shares = [n / len(token) for c, n in Counter(token).items() if ord(c) < 256]
    return -math.fsum(p * math.log2(p) for p in shares)


def entropy_findings(text):
    spans = ((m.span(), m.group()) for m in TOKEN.finditer(text))
    return [(*span, "HIGH_ENTROPY_SECRET", t) for span, t in spans if re.search("[^a-zA-Z_]", t) and entropy(t) > R.ENTROPY_THRESHOLD]


def by_ends(text, value, size=20):
    """From the first head of a value to the next tail, if both are there."""
    head, tail = re.escape(value[:size]), re.escape(value[-size:])
    first = re.search(head, text)
    last = first and re.compile(tail).search(text, first.start())
    return [(first.start(), last.end())] if last else []


def assigned_findings(text, literals):
    def spans(value):
        found = [m.span() for m in re.finditer(re.escape(value), text)]
        return found or (by_ends(text, value) if "\n" in value else [])

    return [(b, e, "SECRET_VAR_ASSIGNMENT", text[b:e]) for value in literals for b, e in spans(value)]


def doc_scan(text, ignore=(), custom=()):
    return sorted((f for f in pattern_findings(text, doc_patterns(custom)) if f[3] not in ignore), key=lambda f: f[0])


def code_scan(text, literals=(), ignore=()):
    rules = [("EMAIL_ADDRESS", R.ENTITY_PATTERNS["EMAIL_ADDRESS"]), *R.CODE_PATTERNS.items()]
    found = chain(pattern_findings(text, rules), entropy_findings(text), assigned_findings(text, literals))
    return sorted((f for f in found if f[3] not in ignore), key=lambda f: (f[0], R.PRIORITIES.get(f[2], 0)), reverse=True)


def scrub(text, findings, counters, vault):
    """``findings`` in scan order; numbers go on from ``counters``.

    Kept spans lie in a sorted list; a finding is free if it fits between its neighbours there. The text is
    put together once, from what lies between kept spans and their placeholders.
    """
    kept = []
    for begin, end, label, snippet in sorted(findings, key=lambda f: -f[0]):
        at = bisect.bisect_left(kept, (begin,))
        if (at == len(kept) or end <= kept[at][0]) and (at == 0 or kept[at - 1][1] <= begin):
            counters[label] = counters.get(label, 0) + 1
            name = f"<{label}_{counters[label]}>"
            vault[name] = snippet
            kept.insert(at, (begin, end, name))
    edges = [0, *(end for _, end, _ in kept)]
    gaps = [text[a:b] for a, b in zip(edges, [*(begin for begin, _, _ in kept), len(text)])]
    return "".join(chain(*zip(gaps, [*(name for _, _, name in kept), ""])))


class _XmlWriter(xml.sax.handler.ContentHandler):
    """Writes a document again from its events. Of text, the part before the first child of an element comes
    with the element, and the part after an element with that element, before the attributes."""

    def __init__(self, one):
        super().__init__()
        self.one, self.events, self.text = one, [], []

    def _flush(self):
        if self.text:
            self.events.append(("text", "".join(self.text)))
            self.text = []

    def startElement(self, name, attrs):  # noqa: N802
        self._flush()
        self.events.append(("open", name, dict(attrs)))

    def endElement(self, name):  # noqa: N802
        self._flush()
        self.events.append(("close", name))

    def characters(self, content):
        self.text.append(content)

    def written(self):
        # where the text after each element stands
        after, open_at = {}, []
        for i, event in enumerate(self.events):
            if event[0] == "open":
                open_at.append(i)
            elif event[0] == "close":
                begin = open_at.pop()
                if i + 1 < len(self.events) and self.events[i + 1][0] == "text":
                    after[begin] = i + 1
        new = {}
        for i, event in enumerate(self.events):
            if event[0] == "open":
                if self.events[i + 1][0] == "text":
                    new[i + 1] = self.one(self.events[i + 1][1])
                if i in after:
                    new[after[i]] = self.one(self.events[after[i]][1])
                new[i] = {k: self.one(v) for k, v in event[2].items()}
        out = []
        for i, event in enumerate(self.events):
            if event[0] == "text":
                out.append(xml.sax.saxutils.escape(new[i]))
            elif event[0] == "open":
                attrs = "".join(f' {k}="{xml.sax.saxutils.escape(v, {chr(34): "&quot;"})}"' for k, v in new[i].items())
                empty = self.events[i + 1] == ("close", event[1])
                out.append(f"<{event[1]}{attrs}{' /' if empty else ''}>")
            elif self.events[i - 1][0] != "open":
                out.append(f"</{event[1]}>")
        return "".join(out)


STRING = re.compile(r'"(?:[^"\\]|\\.)*"(\s*:)?')


def scrub_format(fmt, text, one):
    """A structured text with ``one`` applied to its strings."""
    if fmt == "json":
        # in the written form every string but a key is a token of its own
        return STRING.sub(lambda m: m.group() if m[1] else json.dumps(one(json.loads(m.group()))), json.dumps(json.loads(text), indent=2))
    if fmt == "csv":
        out = io.StringIO()
        csv.writer(out).writerows([one(cell) for cell in row] for row in csv.reader(io.StringIO(text)))
        return out.getvalue()
    if fmt == "xml":
        writer = _XmlWriter(one)
        xml.sax.parseString(text, writer)
        return writer.written()
    return one(text)


def risk(findings):
    return sum(R.WEIGHTS.get(f[2], R.DEFAULT_WEIGHT) for f in findings)
