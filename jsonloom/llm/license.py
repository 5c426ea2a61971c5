"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser evaluates the
tags' and/or/with expressions. An expression counts if it is well-formed and all its licences are known ones.

Phrases are sought in the text's words (A-Z lower-cased, joined by one blank), so they match whole words whatever stands
between them. After an identifier tag the rest of its line is read as an expression.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from jsonloom.llm.common import batches, column, documents, small_batches, texts, word_list

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices, their labels, and how sure each makes of a licence.
NOTICES = {
    "permission is hereby granted free of charge": ("mit", 0.8),
    "lesser general public license": ("lgpl", 0.7),
    "affero general public license": ("agpl", 0.7),
    "mozilla public license": ("mpl", 0.7),
    "eclipse public license": ("epl", 0.7),
    "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "isc license": ("isc", 0.7),
    "boost software license": ("boost", 0.7),
    "creative commons": ("cc", 0.5),
    "licensed under cc by": ("cc", 0.7),
    "licensed under cc0": ("cc", 0.7),
    "public domain": ("public-domain", 0.3),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.7, 0.95
TAG_LINE = re.compile(r"spdx-license-identifier:([^\r\n]*)", re.IGNORECASE)
TOKENS = re.compile(r"\(|\)|[a-z0-9.+:-]+", re.IGNORECASE)
#: Names that public licence identifiers begin with; a version, a variant or nothing follows (a dash, a plus sign, a
#: full stop or a digit comes next, or the end). The longest that fits is the identifier's family.
NAMES = """0bsd aal adobe afl agpl aladdin aml ampas antlr apache apl app apsl arphic artistic beerware bitstream bittorrent blueoak bsd
bsl busl bzip2 cal catosl cc cc-by cc-by-nc cc-by-nc-nd cc-by-nc-sa cc-by-nd cc-by-sa cc-pddc cc0 cddl cdl cdla cecill cern-ohl
clartistic coil cpal cpl cpol cua curl d-fsl doc drl ecl ecos efl egenix elastic epics epl erlpl etalab eudatagrid eupl eurosym
fdk-aac frameworx freeimage fsfap fsful ftl gfdl giftware gl2ps glide gnuplot gpl hpnd icu ijg imagemagick imatix imlib2
info-zip intel interbase ipa ipl isc jasper jpl-image json lal latex2e lgpl lgpllr libpng libselinux libtiff liliq linux-openib
lppl lpl miros mit mpich2 mpl mplus ms-pl ms-rl mulanpsl multics mup naist nasa nbpl ncgl-uk ncsa net-snmp netcdf ngpl nlod nlpl
nokia nosl npl nposl nrl ntp o-uda occt-pl oclc odbl odc-by ofl ogc ogl ogtsl oldap oml openssl opl osl parity pddl php polyform
postgresql psf psutils python qhull qpl rpl rpsl rsa-md rscpl ruby saxpath scea sgi-b shl simpl sissl sleepycat smlnj snia spl
sspl sugarcrm swl tapr-ohl tcl tcp-wrappers tmate torque tosl ucl-1 unicode unlicense upl vim vostrom vsl w3c watcom wtfpl x11
xerox xfree86 xinetd xnet xpp ypl zed zend zimbra zlib zpl""".split()
#: Names whose label is another's, or a plainer one; references to a document's own licences have one label.
LABELS = {"bsl": "boost", **dict.fromkeys(("cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cc0"), "cc")}
OWN = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+\Z", re.IGNORECASE)
KNOWN = re.compile(r"(%s)(?:[-+.0-9][a-z0-9.+-]*)?\Z" % "|".join(sorted(map(re.escape, NAMES), key=lambda x: (-len(x), x))), re.IGNORECASE)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The label of a licence identifier; None for words that are none, NONE and NOASSERTION among them."""
    m = KNOWN.match(identifier)
    return LABELS.get(m[1].lower(), m[1].lower()) if m else "own-terms" if OWN.match(identifier) else None


def reverse_polish(text: str) -> list[str] | None:
    """The expression's tokens in evaluation order by the shunting-yard algorithm; None if it is malformed.

    `with` binds closest, then `and`, then `or`; all associate to the left. Reading stops at what can't continue an
    expression (comment ends, prose), unless a parenthesis is open."""
    out, stack, wants = [], [], True
    for token in TOKENS.findall(text):
        low = token.lower()
        if low in PRECEDENCE:
            if wants:
                return None
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            wants = True
        elif token == "(":
            if not wants:
                break
            stack.append(token)
        elif token == ")":
            if wants or "(" not in stack:
                return None
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if not wants or not token[0].isalnum():
                break
            out.append(token)
            wants = False
    if wants or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(text: str) -> tuple[list[str], list[str]] | None:
    """Identifiers of a licence expression, and a list of its licences' choices: `and` joins with +, `or` offers, `with` adds
    /exception. n pairs of alternatives make 2**n choices, so scans use outline()."""
    order = reverse_polish(text)
    if order is None:
        return None
    stack: list[tuple[set[str], frozenset[str]]] = []
    for token in order:
        if token not in PRECEDENCE:
            stack.append(({token}, frozenset([token])))
            continue
        (names2, right), (names1, left) = stack.pop(), stack.pop()
        if token == "or":
            stack.append((names1 | names2, left | right))
        elif token == "and":
            stack.append((names1 | names2, frozenset("+".join(sorted({*x.split("+"), *y.split("+")})) for x in left for y in right)))
        else:
            stack.append((names1, frozenset(f"{x}/{y}" for x in left for y in right)))
    names, choices = stack.pop()
    return sorted(names), sorted(choices)


def outline(text: str) -> tuple[set[str], str] | None:
    """Identifiers of a licence expression, and its choices in short: `and` joins with +, `or` with |, `with` adds /exception.

    A group has its licences once each, sorted, then the groups inside it. Time and memory grow with the text, where the
    choices that evaluate() lists can grow with two to its power."""
    order = reverse_polish(text)
    if order is None:
        return None
    stack: list = []  # licences, and groups: (operator, licences, groups inside); `with` groups: (operator, left, right)
    for token in order:
        if token not in PRECEDENCE:
            stack.append(token)
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append(f"{left}/{right}" if isinstance(left, str) and isinstance(right, str) else (token, left, right))
            continue
        left, right = (x if x[0] == token else (token, {x}, []) if isinstance(x, str) else (token, set(), [x]) for x in (left, right))
        more, less = (left, right) if len(left[1]) + len(left[2]) >= len(right[1]) + len(right[2]) else (right, left)
        more[1].update(less[1])
        more[2].extend(less[2])
        stack.append(more)
    names, out, todo = set(), [], [(stack.pop(), True)]
    while todo:
        x, named = todo.pop()
        if named is None:
            out.append(x)
        elif isinstance(x, str):
            out.append(x)
            if named:
                names.add(x.split("/")[0])
        else:
            mark = {"and": "+", "or": " | ", "with": "/"}[x[0]]
            parts = [(x[1], named), (x[2], False)] if x[0] == "with" else [(y, named) for y in [*sorted(x[1]), *x[2]]]
            todo.append((")", None))
            for part in reversed(parts[1:]):
                todo += [part, (mark, None)]
            todo += [parts[0], ("(", None)]
    return names, "".join(out)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        out.add_word(f" {phrase} ", phrase)
    out.make_automaton()
    return out


def scan(data: bytes) -> tuple[int, list[tuple[int, str]], set[str], set[str], list[str], float]:
    """n_words, base places (word, label), base labels, all labels, the tags' choices, score."""
    words = word_list(data)
    joined = b" " + b" ".join(words) + b" "
    base, labels, choices, doubt, tagged = [], set(), [], 1.0, False
    counted, at = 0, 0
    for end, phrase in sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton().iter(joined.decode("latin-1"))):
        counted, at = counted + joined.count(b" ", at, end), end
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            base.append((counted, BASE[phrase]))
            doubt *= 1 - BASE_WEIGHT
        else:
            label, weight = NOTICES[phrase]
            labels.add(label)
            doubt *= 1 - weight
    if tagged:
        for m in TAG_LINE.finditer(data.decode("utf-8", "replace")):
            found = outline(m[1])
            families = {family(x) for x in found[0]} if found else {None}
            if None not in families:
                labels |= families
                choices.append(found[1])
                doubt *= 1 - TAG_WEIGHT
    base_labels = {label for _, label in base}
    return len(words), base, base_labels, labels | base_labels, choices, 1 - doubt


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, choices (the outline of each identifier tag that counts) and
    score (0: nothing found) of each row. A null text is an empty one; places count all, overlapping ones too; repeated rows are
    scanned each for itself; an empty table gives no rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(found):
        for b in found:
            schema = pa.schema([b.schema.field("doc_id"), *((k, pa.int64()) for k in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("choices", pa.list_(pa.string())), ("score", pa.float64())])
            out = [[] for _ in schema]
            for doc, body in zip(column(b, "doc_id"), column(b, "body")):
                n, base, base_labels, labels, choices, score = scan(body or b"")
                at = [w for w, _ in base]
                for x, v in zip(out, (doc, n, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), choices, score)):
                    x.append(v)
            yield from batches(schema, [out])

    return texts(docs, "doc_id").mapInArrow(each, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, choices array<string>, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row; see licenses."""
    small_batches(spark)
    return licenses(documents(spark, sf_dir)).drop("choices")
