"""License scan by ordered signature rules.

Texts are normalised to lower-case words joined by single blanks. Several hundred rules are
regular expressions over such words: sentences of license texts and notices, written by hand
(signatures.py), and for each license family its tag, its address, its name in a grant, beside the
word license and, where the name is no common word, by itself. Each rule needs keywords;
one automaton finds those of all rules in one pass over a text, and only rules whose keywords are there
are tried. Overlapping detections are resolved by priority and containment: one that
lies inside a detection of higher priority, or of equal priority that is longer, or of equal span
that is listed earlier, is suppressed. Base phrases are rules of their own that nothing suppresses.

One pass over the scan, no shuffle.
"""

from __future__ import annotations

import collections
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K
from .signatures import SIGNATURES

#: Bytes that end a word become blanks, A-Z become a-z.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: Phrases whose places are counted, with their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Per family: label, names as expressions over words, SPDX words, address words.
FAMILIES = (
    ("mit", "(?:mit|expat|x11)", "mit", "opensource org licenses mit"),
    ("apache-2", "apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", "apache 2 0", "www apache org licenses license 2 0"),
    ("apache-1.1", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1", "www apache org licenses license 1 1"),
    ("bsd-3-clause", "(?:(?:new|modified|revised) bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "(?:(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd", "(?:berkeley software distribution|bsd(?: style)?)", "bsd", "opensource org licenses bsd license"),
    ("0bsd", "(?:zero clause bsd|bsd zero clause|0bsd)", "0bsd", "opensource org licenses 0bsd"),
    ("isc", "isc", "isc", "opensource org licenses isc"),
    ("zlib", "zlib(?: libpng)?", "zlib", "opensource org licenses zlib"),
    ("gpl-1", "(?:gnu (?:general public license|gpl)|gpl) ?(?:version |v ?)?1", "gpl 1 0", "www gnu org licenses old licenses gpl 1 0"),
    ("gpl-2", "(?:gnu (?:general public license|gpl)|gpl) ?(?:version |v ?)?2", "gpl 2 0", "www gnu org licenses old licenses gpl 2 0"),
    ("gpl-3", "(?:gnu (?:general public license|gpl)|gpl) ?(?:version |v ?)?3", "gpl 3 0", "www gnu org licenses gpl 3 0"),
    ("lgpl-2", "(?:gnu (?:library|lesser) general public license|lgpl) ?(?:version |v ?)?2", "lgpl 2 0", "www gnu org licenses old licenses lgpl 2 0"),
    ("lgpl-2.1", "(?:gnu lesser general public license|lgpl) ?(?:version |v ?)?2 1", "lgpl 2 1", "www gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3", "(?:gnu lesser general public license|lgpl) ?(?:version |v ?)?3", "lgpl 3 0", "www gnu org licenses lgpl 3 0"),
    ("agpl-3", "(?:gnu affero general public license|agpl) ?(?:version |v ?)?3", "agpl 3 0", "www gnu org licenses agpl 3 0"),
    ("gfdl", "(?:gnu free documentation license|gfdl)", "gfdl 1 3", "www gnu org licenses fdl"),
    ("mpl-1.1", "(?:mozilla public license|mpl) ?(?:version |v ?)?1 1", "mpl 1 1", "www mozilla org mpl 1 1"),
    ("mpl-2", "(?:mozilla public license|mpl) ?(?:version |v ?)?2", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1", "(?:eclipse public license|epl) ?(?:version |v ?)?1", "epl 1 0", "www eclipse org legal epl v10"),
    ("epl-2", "(?:eclipse public license|epl) ?(?:version |v ?)?2", "epl 2 0", "www eclipse org legal epl 2 0"),
    ("cddl-1", "(?:common development and distribution license|cddl) ?(?:version |v ?)?1", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cpl-1", "common public license ?(?:version |v ?)?1", "cpl 1 0", "opensource org licenses cpl1 0"),
    ("eupl-1.2", "(?:european union public licen[cs]e|eupl) ?(?:version |v ?)?1 2", "eupl 1 2", "joinup ec europa eu collection eupl"),
    ("artistic-1", "artistic license ?(?:version |v ?)?1", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2", "artistic license ?(?:version |v ?)?2", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("boost-1", "boost software license(?: version)?(?: 1 0)?", "bsl 1 0", "www boost org license 1 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense org"),
    ("wtfpl", "(?:do what the fuck you want to public license|wtfpl)", "wtfpl", "www wtfpl net"),
    ("ms-pl", "(?:microsoft public license|ms pl)", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "(?:microsoft reciprocal license|ms rl)", "ms rl", "opensource org licenses ms rl"),
    ("ofl-1.1", "(?:sil open font license|ofl) ?(?:version )?1 1", "ofl 1 1", "scripts sil org ofl"),
    ("python-2", "(?:python software foundation|psf) license(?: version 2)?", "psf 2 0", "docs python org license"),
    ("php-3", "php license(?: version)? 3", "php 3 01", "www php net license 3 01"),
    ("ruby", "ruby license", "ruby", "www ruby lang org en license"),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "www postgresql org about licence"),
    ("openssl", "openssl license", "openssl", "www openssl org source license"),
    ("w3c", "w3c (?:software notice and )?license", "w3c", "www w3 org consortium legal"),
    ("ncsa", "university of illinois ncsa open source", "ncsa", "opensource org licenses ncsa"),
    ("upl-1", "universal permissive license", "upl 1 0", "oss oracle com licenses upl"),
    ("bsl-1.1", "business source license(?: 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("sspl-1", "server side public license", "sspl 1 0", "www mongodb com licensing server side public license"),
    ("elastic-2", "elastic license ?(?:version )?2", "elastic 2 0", "www elastic co licensing elastic license"),
    ("cc0-1", "(?:cc0|creative commons zero)(?: 1 0)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "(?:creative commons attribution|cc by)(?: international)?(?: license)?(?: [1-4] 0)?", "cc by 4 0", "creativecommons org licenses by"),
    ("cc-by-sa", "(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] 0)?", "cc by sa 4 0", "creativecommons org licenses by sa"),
    ("cc-by-nc", "(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] 0)?", "cc by nc 4 0", "creativecommons org licenses by nc"),
    ("cc-by-nd", "(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: [1-4] 0)?", "cc by nd 4 0", "creativecommons org licenses by nd"),
    ("cc-by-nc-sa", "(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] 0)?", "cc by nc sa 4 0", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", "(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: [1-4] 0)?", "cc by nc nd 4 0", "creativecommons org licenses by nc nd"),
    ("odbl-1", "(?:open database license|odbl)", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1", "open data commons attribution license", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1", "public domain dedication and license", "pddl 1 0", "opendatacommons org licenses pddl"),
)

#: Loose mentions: label, expression, priority.
MARKS = (
    ("gpl", "gnu general public licen[cs]e", 40),
    ("lgpl", "gnu lesser general public licen[cs]e", 45),
    ("public-domain", "(?:released into|dedicated to|placed in) the public domain", 60),
    ("all-rights-reserved", "all rights reserved", 60),
    ("creative-commons", "creative commons", 30),
)

#: Families whose names are common words or short: a rule needs the word license beside them.
SHORT_NAMES = {"mit", "apache-2", "apache-1.1", "bsd", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "cc-by"}
#: Strings one of which a text must hold for a name in a grant, or beside the word license, to match.
GRANT, NAMED = (" under ", " subject to ", " governed by ", " according to "), ("licen",)


@dataclass(frozen=True)
class Rule:
    """gates: groups of keywords; a text that lacks every keyword of a group cannot match."""

    label: str
    pattern: re.Pattern
    gates: tuple[tuple[str, ...], ...]
    priority: int
    weight: float
    base: bool = False


def alternatives(expression: str) -> list[str]:
    """What an expression, or the group that it begins with, chooses from."""
    out, depth, begin = [], 0, 0
    inner = 1 if expression.startswith("(?:") else 0
    for i, c in enumerate(expression):
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == inner:
            out.append(expression[begin:i])
            begin = i + 1
        if inner and depth == 0:
            return [x.removeprefix("(?:") for x in [*out, expression[begin:i]]] if not expression.startswith("?", i + 1) else [expression]
    return [*out, expression[begin:]]


def keywords(expression: str) -> tuple[str, ...]:
    """For each alternative its longest run of plain characters, behind the blank that any match follows if it is the first."""
    out = []
    for plain in alternatives(expression):
        plain = re.sub(r"\[[^]]*\]\??", "\0", plain)
        while re.search(r"\([^()]*\)", plain):
            plain = re.sub(r"\([^()]*\)(?:\?|\{[0-9,]*\}\??)?", "\0", plain)
        runs = re.split("[\0()|]", re.sub(r".\?", "\0", plain))
        longest = max(runs, key=len)
        out.append((" " if runs[0] == longest else "") + longest.strip())
    return tuple(out)


@functools.lru_cache(maxsize=1)
def ruleset() -> tuple[Rule, ...]:
    """All rules, the highest priority first."""

    def rule(label: str, expression: str, priority: int, weight: float, *gates: tuple[str, ...], base: bool = False) -> Rule:
        return Rule(label, re.compile(rb"(?<= )(?:" + expression.encode() + rb")(?= )"), gates, priority, weight, base)

    out = [rule(label, phrase, 100, 0.9, (phrase,), base=True) for phrase, label in BASE]
    out += [rule(label, expression, priority, priority / 100, keywords(expression)) for expression, label, priority in SIGNATURES]
    out += [rule(label, expression, priority, priority / 100, keywords(expression)) for label, expression, priority in MARKS]
    for label, name, spdx, address in FAMILIES:
        keys = keywords(name)
        out.append(rule(label, f"spdx license identifier {spdx}(?: or later| only)?", 99, 0.95, (f"spdx license identifier {spdx}",)))
        out.append(rule(label, f"(?:https? )?{address}", 80, 0.85, (address,)))
        terms = "(?:the )?(?:terms of )?(?:the )?"
        out.append(rule(label, f"(?:licensed under|released under|distributed under|available under|published under|provided under|covered under|subject to|governed by|according to) {terms}{name}(?: licen[cs]e)?", 70, 0.9, GRANT, keys))
        out.append(rule(label, f"(?:licen[cs]e(?: type)? {name}|(?:the )?{name}(?: public)? licen[cs]e)", 58, 0.6, NAMED, keys))
        if label not in SHORT_NAMES:
            out.append(rule(label, name, 50, 0.5, keys))
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.lru_cache(maxsize=1)
def prefilter() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    """The automaton of all keywords; for each keyword of a rule's last group, the rules' numbers."""
    machine, rules = ahocorasick.Automaton(), collections.defaultdict(list)
    for n, r in enumerate(ruleset()):
        for key in {k for group in r.gates for k in group}:
            machine.add_word(key, key)
        for key in r.gates[-1]:
            rules[key].append(n)
    machine.make_automaton()
    return machine, dict(rules)


def candidates(line: bytes) -> list[Rule]:
    """The rules whose keywords line holds, the highest priority first."""
    machine, rules = prefilter()
    there = {key for _, key in machine.iter(line.decode("latin-1"))}
    numbers = {n for key in there for n in rules.get(key, ())}
    return [r for r in map(ruleset().__getitem__, sorted(numbers)) if all(not there.isdisjoint(group) for group in r.gates)]


def normalise(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text after A-Z are lower-cased."""
    return (text or b"").translate(_FOLD).split()


def _places(rule: Rule, line: bytes) -> Iterator[tuple[int, int]]:
    """Matches; those of a base phrase may overlap."""
    at = 0
    while m := rule.pattern.search(line, at):
        yield m.span()
        at = m.start() + 1 if rule.base else max(m.end(), m.start() + 1)


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that lie in none of higher priority, nor in a longer or earlier-listed one of the same priority."""
    kept, reach = [], {}
    for start, end, rule in sorted(found, key=lambda x: (x[0], -x[1], -x[2].priority)):
        if rule.base or not any(stop >= end and level >= rule.priority for level, stop in reach.items()):
            kept.append((start, end, rule))
        reach[rule.priority] = max(end, reach.get(rule.priority, 0))
    return kept


def scan(text: bytes | None) -> tuple[int, list[tuple[int, int, Rule]]]:
    """Number of words; detections (first word, word after the last, rule)."""
    words = normalise(text)
    line = b" " + b" ".join(words) + b" "
    found = [(a, b, r) for r in candidates(line) for a, b in _places(r, line)]
    if not found:
        return len(words), []
    place, at, count = {}, 0, -1
    for x in sorted({p for a, b, _ in found for p in (a, b)}):
        count += line.count(b" ", at, x)
        at = x
        place[x] = count
    return len(words), [(place[a], place[b] + 1, r) for a, b, r in resolve(found)]


SCHEMA = "doc_id long, n_words long, detections array<struct<label:string,first:long,last:long,priority:int,weight:double,base:boolean>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words and its detections (words first to last, from 0), in order of place.

    Null and empty texts, and those without words, have no words and no detections. Repeated rows and rows of
    null id are scanned like others. Of detections with equal span and priority the rule listed first stays.
    Ids are whole numbers; a text id that is none is an error. An empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("priority", pa.int32()), ("weight", pa.float64()), ("base", pa.bool_())]))

    def run(batch: pa.RecordBatch) -> dict:
        scans = [scan(t) for t in K.texts_of(batch, "text")]
        rows = [[{"label": r.label, "first": a, "last": b - 1, "priority": r.priority, "weight": r.weight, "base": r.base} for a, b, r in found] for _, found in scans]
        return {"doc_id": batch["id"].cast(pa.int64()), "n_words": [n for n, _ in scans], "detections": pa.array(rows, kind)}

    return K.map_texts(docs, run, SCHEMA, id_col, text_col)
