"""Personal data: four base kinds by pattern, and mentions that a skip-chain field adds.

Mail addresses, IP addresses, card and phone numbers in their full form are the base; patterns
find them in time linear in the text. The field (`skip_chain`) decides on further candidates:

* numbers of at least seven digits that no base pattern takes (a phone number without its country
  code, a card number with other separators, an address with other marks between its parts);
* mail addresses that are written out (`name at host dot org`, `name (at) host.org`);
* capitalised words, in documents that introduce a person (`Mr`, `my name is`, ...) or hold a
  mail address made of such a word; neighbouring words of a person are one span.

Candidates that stand side by side are neighbours of the chain. Candidates that share a key
(the last seven digits, the address without its disguise, the word) are tied, with base spans as
evidence, so that what a document shows to be personal data in one place is found in all its
places. Words and numbers outside candidates count as observed to be nothing, so the chain is cut
there and texts without candidates cost no more than the patterns.

The weights are fitted on a bounded sample, TRAIN_TEXTS pieces of TRAIN_CHARS characters of the
given texts, into which made-up mentions are set, in full and disguised, with and without cues,
and numbers and names that are nothing of the kind. No lists of names are used.

A null text is empty and has no spans. Texts of any length are read whole. Repeated rows each get
their own result, an empty table an empty one; further columns of the input are ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uptakelens.llm import skip_chain
from uptakelens.llm.ragged import released

KINDS = ["email", "ip", "card", "phone", "person"]
BASE = 4
LABELS = ["none", *KINDS]

#: Fixed by the contract. A run of digits, and one of a mail's first part, is entered at its
#: beginning only: a match that began further on would have begun there.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

TRAIN_TEXTS = 300
TRAIN_CHARS = 1500
#: Bytes of texts whose candidates form one graph.
BATCH = 8 << 20


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of card numbers."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ is met once, its run to the left up to the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        run = at
        while run > done and (text[run - 1].isascii() and (text[run - 1].isalnum() or text[run - 1] in "._%+-")):
            run -= 1
        found = _DOMAIN.match(text, at + 1) if run < at else None
        if found:
            yield run, found.end()
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind, begin and end of the base spans, by kind and begin."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


# -- candidates --------------------------------------------------------------------

_NUMBER = re.compile(r"(?<![\w.])\+?[(\[]?[0-9](?:(?:[-./,_]| {1,2}|\)[ -]?| \(| [-./] )?[0-9])*+(?![^\W_])")
_AT = re.compile(r" ?[(\[{]at[)\]}] ?| at ")
_HANDLE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:(?: ?[(\[{]dot[)\]}] ?| dot |\.)[A-Za-z0-9-]+)+")
_DOT = re.compile(r" ?[(\[{]dot[)\]}] ?| dot ")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: Cue words, fixed values; the last word before a candidate is compared with them.
TITLES = set("mr mrs ms dr prof herr frau mme mlle sr sra srta señor señora".split())
NAME_CUES = set("name nom nombre heiße m'appelle llamo dear cher chère liebe lieber querido querida signed".split())
PHONE_CUES = set("tel phone telephone call fax mobile cell handy telefon téléphone teléfono móvil portable".split())
CARD_CUES = set("card visa mastercard amex credit debit karte kreditkarte carte tarjeta kartennummer".split())
IP_CUES = set("ip ipv4 host server address gateway adresse dirección hôte".split())
MAIL_CUES = set("mail email e-mail write contact correo courriel schreib kontakt contacto".split())
#: A person is introduced (RE2 syntax; also the first look over a batch).
INTRODUCED = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Srta|Señor|Señora)\.? [A-ZÀ-Þ]|\b(?:[Mm]y name is|Name:|Nom ?:|Nombre:|[Ii]ch heiße|m'appelle|[Mm]e llamo|Dear|Cher|Chère|Lieber?|Querid[oa]|Signed:?) [A-ZÀ-Þ]"
_INTRODUCED = re.compile(INTRODUCED)
LOOK = f"[0-9@]|[(\\[{{]at[)\\]}}]| dot |{INTRODUCED}"

FEATURES = (
    "bias number written word digits7 digits9 digits13 digits20 luhn plus brackets separated dots4 date "
    "bare cue_name cue_phone cue_card cue_ip cue_mail starts capitals also_lower in_mail next_capital "
    "short marked_at spelled_dot plain_at"
).split()
_F = {name: i for i, name in enumerate(FEATURES)}
_DATE = re.compile(r"(?:19|20)\d\d[-/.]\d\d?[-/.]\d\d?|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d")


@dataclass
class Node:
    """A candidate or base span: `fixed` is a label or -1, `key` ties it to others."""

    begin: int
    end: int
    fixed: int
    features: list[int]
    key: str | None


def _cues(text: str, begin: int) -> list[int]:
    """Features of the last three words before a place."""
    before = [w.lower() for w in re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", text[max(0, begin - 40) : begin])[-3:]]
    kinds = (("cue_phone", PHONE_CUES), ("cue_card", CARD_CUES), ("cue_ip", IP_CUES), ("cue_mail", MAIL_CUES))
    return [_F[name] for name, cues in kinds if any(w in cues for w in before)]


def _number(text: str, begin: int, end: int) -> Node | None:
    value = text[begin:end]
    digits = _NO_DIGIT.sub("", value)
    n = len(digits)
    if n < 7:
        return None
    size = "digits7" if n < 9 else "digits9" if n < 13 else "digits13" if n < 20 else "digits20"
    on = ["bias", "number", size]
    on += ["luhn"] if 13 <= n <= 19 and luhn(digits) else []
    on += ["plus"] if value[0] == "+" else []
    on += ["brackets"] if "(" in value or "[" in value else []
    on += ["bare"] if value.isdigit() else ["separated"]
    parts = re.findall("[0-9]+", value) if n <= 12 else []
    on += ["dots4"] if len(parts) == 4 and all(int(x) <= 255 for x in parts) else []
    on += ["date"] if _DATE.search(value) else []
    return Node(begin, end, -1, [*(_F[x] for x in on), *_cues(text, begin)], f"n{digits[-7:]}")


def _numbers(text: str) -> Iterator[Node]:
    """Numbers; a run of more digits than any kind has is taken apart at its spaces."""
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        whole = _number(text, *m.span())
        if whole and _F["digits20"] not in whole.features:
            yield whole
        elif whole:
            parts = (_number(text, m.start() + p.start(), m.start() + p.end()) for p in re.finditer("[^ ]+", m[0]))
            yield from filter(None, parts)


def _written(text: str) -> Iterator[Node]:
    """Mail addresses with their signs spelled out."""
    for m in _AT.finditer(text):
        handle = _HANDLE.search(text, max(0, m.start() - 64), m.start())
        host = _HOST.match(text, m.end()) if handle else None
        if not host:
            continue
        marked, spelled = m[0].strip() != "at", bool(_DOT.search(host[0]))
        if not (marked or spelled):
            continue
        on = ["bias", "written", "marked_at" if marked else "plain_at", *(["spelled_dot"] if spelled else [])]
        address = f"{handle[0]}@{_DOT.sub('.', host[0])}".lower()
        yield Node(handle.start(), host.end(), -1, [*(_F[x] for x in on), *_cues(text, handle.start())], f"m{address}")


def _names(text: str, base: Sequence[tuple[int, int, int]], pieces: set[str]) -> Iterator[Node]:
    """Capitalised words. One that also occurs in lower case, outside of base spans, is no sign
    of a name, even if a mail address has it."""
    taken = {i for k, b, e in base if k == 0 for i in range(b, e)}
    words = [(m.start(), m.end()) for m in _WORD.finditer(text) if m.start() not in taken]
    lower = {text[b:e] for b, e in words if text[b].islower()}
    for i, (b, e) in enumerate(words):
        word = text[b:e]
        if not word[0].isupper():
            continue
        before = text[max(0, b - 4) : b].rstrip(" \"'(")
        previous = text[slice(*words[i - 1])].lower() if i else ""
        gap = text[words[i - 1][1] : b] if i else ""
        titled = previous in TITLES and gap in (" ", ". ")
        named = previous in NAME_CUES and gap in (" ", ": ", " : ")
        named |= gap == " " and text[max(0, b - 8) : b].lower() == "name is "
        starts = not before or before[-1] in ".!?:;\n|" and not titled and not named
        following = words[i + 1] if i + 1 < len(words) else (len(text) + 9, 0)
        if word.lower() in (previous, text[slice(*following)].lower()):
            continue  # one word again and again is no name
        on = ["bias", "word"]
        on += ["cue_name"] if titled or named else []
        on += ["starts"] if starts else []
        on += ["capitals"] if len(word) > 1 and word.isupper() else []
        on += ["also_lower"] if word.lower() in lower else []
        on += ["in_mail"] if word.lower() in pieces and word.lower() not in lower and not starts else []
        on += ["next_capital"] if following[0] - e == 1 and text[following[0]].isupper() else []
        on += ["short"] if e - b < 3 else []
        yield Node(b, e, -1, [_F[x] for x in on], f"w{word.lower()}")


def nodes(text: str, base: Sequence[tuple[int, int, int]]) -> list[Node]:
    """Base spans as evidence and the candidates that touch none of them, by place."""
    found, pieces = [], set()
    for kind, b, e in base:
        value = text[b:e]
        digits = _NO_DIGIT.sub("", value)
        key = f"m{value.lower()}" if kind == 0 else f"n{digits[-7:]}" if len(digits) >= 7 else None
        found.append(Node(b, e, kind + 1, [], key))
        if kind == 0:
            pieces |= {p.lower() for p in re.split(r"[^A-Za-z]+", value.split("@")[0]) if len(p) > 2}
    free = list(_written(text)) if " dot " in text or re.search(r"[(\[{]at[)\]}]", text) else []
    free += _numbers(text)
    people = list(_names(text, base, pieces)) if pieces or _INTRODUCED.search(text) else []
    if any(_F["cue_name"] in p.features or _F["in_mail"] in p.features for p in people):
        free += people
    found.sort(key=lambda x: x.begin)
    starts = [x.begin for x in found]
    reach = np.maximum.accumulate([x.end for x in found]) if found else []
    for x in free:  # written addresses come first and keep out what lies in them
        k = int(np.searchsorted(starts, x.end))  # base spans that begin before its end
        if k and reach[k - 1] > x.begin:
            continue
        found.append(x)
    out, end = [], 0
    for x in sorted(found, key=lambda x: (x.begin, -x.end)):
        if x.fixed >= 0 or x.begin >= end:
            out.append(x)
            end = max(end, x.end)
    return out


def graph(documents: Sequence[tuple[str, list[Node]]]) -> skip_chain.Graph:
    """The documents' nodes with their neighbours and ties."""
    node, feature, fixed, chain, skip = [], [], [], [], []
    hubs = n = 0
    for text, found in documents:
        keys = defaultdict(list)
        for i, x in enumerate(found):
            node += [n + i] * len(x.features)
            feature += x.features
            fixed.append(x.fixed)
            if x.key:
                keys[x.key].append(n + i)
            if i and text[found[i - 1].end : x.begin] in ("", " ", ", "):
                chain.append((n + i - 1, n + i))
        for members in keys.values():
            if len(members) > 1:
                skip += [(m, hubs) for m in members]
                hubs += 1
        n += len(found)

    def pairs(x):
        return np.array(x, np.int64).reshape(-1, 2).T

    return skip_chain.Graph(
        n, np.array([node, feature], np.int64).reshape(2, -1), np.array(fixed, np.int64), pairs(chain), pairs(skip), hubs
    )


# -- training ----------------------------------------------------------------------


def _mentions(draw: random.Random) -> list[tuple[str, int]]:
    """Texts to be set into a document, with their labels: one entity, or things that are none."""
    def digits(n):
        return "".join(draw.choices("0123456789", k=n))

    def name():
        return "".join(draw.choice("bdfgklmnprstvz") + draw.choice("aeiou") for _ in range(draw.randint(2, 4))).capitalize()

    kind = draw.choice(["phone", "card", "ip", "email", "person", "person", "none", "none", "places"])
    cue, full = draw.random() < 0.4, draw.random() < 0.75
    n = draw.randint(1, 3)
    if kind == "phone":
        area, local = digits(3), (digits(3), digits(4))
        said = draw.choice(["call ", "phone: ", "Tel. ", "fax "])
        forms = [f"({area}) {local[0]}-{local[1]}", f"{area}-{local[0]}-{local[1]}", f"{area} {local[0]} {local[1]}", f"{local[0]}-{local[1]}", f"{area}{local[0]}{local[1]}"]
        first = f"+{draw.randint(1, 99)} ({area}) {local[0]}-{local[1]}"
    elif kind == "card":
        head = digits(15)
        whole = next(head + d for d in "0123456789" if luhn(head + d))
        quads = [whole[i : i + 4] for i in range(0, 16, 4)]
        forms = [x.join(quads) for x in (".", "/", "  ", "_")]
        cue = True
        said, first = draw.choice(["card ", "Visa: ", "credit card ", "", "", ""]), draw.choice(["", " ", "-"]).join(quads)
    elif kind == "ip":
        parts = [str(draw.randint(10, 255)) for _ in range(4)]
        forms = [x.join(parts) for x in ("-", " . ", ",", "_")]
        said, first = draw.choice(["host ", "IP: ", "server "]), ".".join(parts)
    elif kind == "email":
        who, host = f"{name().lower()}{draw.choice(['', '.', '_'])}{digits(draw.randint(0, 2))}", name().lower()
        who = who.rstrip("._") or who
        end = draw.choice(["com", "org", "net", "de"])
        forms = [f"{who} at {host} dot {end}", f"{who} (at) {host}.{end}", f"{who}[at]{host}[dot]{end}", f"{who} [at] {host} (dot) {end}"]
        said, first = draw.choice(["mail ", "write to ", "contact ", "", "", ""]), f"{who}@{host}.{end}"
        cue = True  # a disguise is a sign by itself, as a card's check digit is
    elif kind == "person":
        given, family = name(), name()
        intro = draw.choice(["Mr ", "Mrs. ", "Dr. ", "my name is ", "Dear ", "Herr ", "Mme ", "Name: ", ""])
        out = [(intro, 0), (f"{given} {family}", 5)] if intro else [(f"{given}.{family}@mail.example.com".lower(), 1)]
        return [*out, *((" ", 0), (draw.choice([given, family, f"{given} {family}"]), 5)) * n]
    elif kind == "places":
        return [(f"{draw.choice(['in', 'from', 'to'])} ", 0), (name(), 0)]
    else:
        made = [digits(draw.randint(7, 12)), f"20{digits(2)}-0{draw.randint(1, 9)}-1{digits(1)} 10:{draw.randint(10, 59)}", f"{digits(1)},{digits(3)},{digits(3)}", f"no. {digits(3)}-{digits(4)}", digits(16), f"978-3-{digits(2)}-{digits(6)}-{digits(1)}", f"{name().lower()} at home dot then"]
        return [(draw.choice(made), 0)] * n
    label = KINDS.index(kind) + 1
    out = [(first, label)] if full else []
    for form in draw.choices(forms, k=n):
        shown = full or cue
        out += [(said, 0)] if cue and said else []
        out.append((form, label if shown else 0))
    return out


def labelled(texts: Sequence[str], seed: int = 0) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The texts with mentions set in between words, and the mentions' label, begin and end."""
    draw = random.Random(seed)
    out = []
    for text in texts:
        words = text.split(" ")
        added: dict[int, list] = defaultdict(list)
        for _ in range(draw.randint(1, 3)):
            group, run = _mentions(draw), []
            places = sorted(draw.choices(range(len(words) + 1), k=len(group)))
            for place, item in zip(places, group, strict=True):
                run.append(item)
                if item[1] or item is group[-1] or not item[0].endswith(" "):
                    added[place].append(run)
                    run = []
        made, spans = "", []
        for i in range(len(words) + 1):
            for run in added[i]:
                made += " " if made and not made.endswith((" ", "\n")) else ""
                for piece, label in run:
                    if label:
                        spans.append((label, len(made), len(made) + len(piece)))
                    made += piece
                made += draw.choice([" ", ". ", ", "])
            if i < len(words):
                made += ("" if not made or made.endswith((" ", "\n")) else " ") + words[i]
        out.append((made, spans))
    return out


def truth(found: list[Node], spans: Sequence[tuple[int, int, int]]) -> list[int]:
    """Label of each node: that of the mention that covers most of it, or its fixed one."""
    out = []
    for x in found:
        label = next((k for k, b, e in spans if b < x.end and e > x.begin and 2 * (min(e, x.end) - max(b, x.begin)) > x.end - x.begin), 0)
        out.append(x.fixed if x.fixed >= 0 else label)
    return out


def fit(texts: Sequence[str], seed: int = 0) -> skip_chain.Weights:
    """Weights from texts with mentions set into them."""
    documents, labels = [], []
    for text, spans in labelled(texts, seed):
        found = nodes(text, base_spans(text))
        documents.append((text, found))
        labels += truth(found, spans)
    made, labels = graph(documents), np.array(labels, np.int64)
    hub = np.zeros(made.n_hubs, np.int64)
    np.maximum.at(hub, made.skip[1], labels[made.skip[0]])
    return skip_chain.fitted(made, labels, hub, len(FEATURES), len(LABELS))


def train(docs: DataFrame, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS) -> skip_chain.Weights:
    """Weights fitted on a bounded sample of the texts, the same whatever their order: of each of
    so many classes of hashes the least one. No more than these go to the driver."""
    piece = docs.filter("text IS NOT NULL AND text <> ''").selectExpr(f"substring(text, 1, {int(chars)}) AS text")
    hashed = piece.withColumn("hash", F.xxhash64("text"))
    least = hashed.groupBy(F.expr(f"pmod(hash, {int(texts)})")).agg(F.min("hash").alias("hash"))
    chosen = sorted(r.hash for r in least.select("hash").collect())
    rows = hashed.filter(F.col("hash").isin(chosen)).select("text").distinct().collect()
    own = sorted(r.text for r in rows)
    return fit([own[i % len(own)] if own else "" for i in range(int(texts))])


# -- finding -----------------------------------------------------------------------


def found_in(texts: Sequence[str], weights: skip_chain.Weights) -> list[list[tuple[int, int, int, bool]]]:
    """Kind, begin, end and whether the field added it, of every span of the texts."""
    base = [base_spans(t) for t in texts]
    documents = [(t, nodes(t, b)) for t, b in zip(texts, base, strict=True)]
    label = skip_chain.labels(graph(documents), weights)
    out, n = [], 0
    for (text, own), spans in zip(documents, base, strict=True):
        added: list[list] = []
        for x, k in zip(own, label[n : n + len(own)].tolist(), strict=True):
            if x.fixed >= 0 or k == 0:
                continue
            last = added[-1] if added else None
            if last and k == len(KINDS) and last[0] == k - 1 and text[last[2] : x.begin] == " ":
                last[2] = x.end
            else:
                added.append([k - 1, x.begin, x.end])
        n += len(own)
        out.append(sorted([(*s, False) for s in spans] + [(*s, True) for s in added]))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("added", pa.bool_())]))
SPANS = "array<struct<kind:int,begin:bigint,end:bigint,added:boolean>>"


def _finder(weights: skip_chain.Weights):
    """A function on Arrow columns: only texts that a first look singles out are gone into."""

    def find(column: pa.Array) -> pa.Array:
        column = pc.fill_null(column, "")
        look = np.flatnonzero(pc.match_substring_regex(column, LOOK).to_numpy(zero_copy_only=False))
        out: list[list[dict]] = [[] for _ in range(len(column))]
        names = ("kind", "begin", "end", "added")
        run, size = [], 0
        for i in [*look.tolist(), -1]:
            if i >= 0:
                run.append((i, column[i].as_py()))
                size += len(run[-1][1])
            if run and (i < 0 or size >= BATCH):
                found = found_in([t for _, t in run], weights)
                for (k, _), spans in zip(run, found, strict=True):
                    out[k] = [dict(zip(names, s, strict=True)) for s in spans]
                run, size = [], 0
        released()
        return pa.array(out, _SPANS)

    return find


def with_spans(docs: DataFrame, weights: skip_chain.Weights) -> DataFrame:
    """doc_id and found, the spans of the whole text by kind and begin."""
    find = F.arrow_udf(_finder(weights), SPANS)
    return docs.select("doc_id", find("text").alias("found"))


def masked(docs: DataFrame, weights: skip_chain.Weights) -> DataFrame:
    """doc_id and the text with every span as its kind in brackets; spans that touch or overlap
    are one, of the first's kind. A null text stays null."""
    find = _finder(weights)

    def hide(column: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(column.to_pylist(), find(column).to_pylist(), strict=True):
            pieces, done = [], 0
            for b, e, k in sorted((s["begin"], s["end"], s["kind"]) for s in spans):
                if b >= done:
                    pieces += [text[done:b], f"[{KINDS[k].upper()}]"]
                done = max(done, e)
            out.append(text if text is None else "".join(pieces) + text[done:])
        return pa.array(out, pa.string())

    return docs.select("doc_id", F.arrow_udf(hide, "string")("text").alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans."""
    rows = with_spans(docs, train(docs))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"

    def joined(test: str) -> str:
        return (
            f"array_join(transform(filter(found, s -> {test}),"
            f" s -> concat({names}[s.kind], ':', s.begin, ':', s.end)), ',')"
        )

    counts = [
        F.expr(f"bigint(size(filter(found, s -> s.kind = {k} AND NOT s.added)))").alias(f"n_{KINDS[k]}")
        for k in range(BASE)
    ]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(joined("NOT s.added")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined("true")).alias("spans"),
    )
