"""Personal data: fixed expressions, and a linear-chain conditional random field for what they miss.

The field labels white-space tokens from word-shape features. It is trained on a small labelled
table of phrases by gradient ascent on the exact likelihood (forward-backward), and decodes by
Viterbi over numpy batches of whole texts, so neither a token nor a run of labels has a longest
length. Tokens of one signature share their features, which are computed once. Texts without a
digit, ``@``, an "at" in brackets or a "dot" are not decoded: no kind's test passes without one of them.

Kinds, in this order: email, ip, card, phone. Spans are code points, the end exclusive. Base spans
always stay. A labelled run is added where it overlaps no base span and passes its kind's own
test (digits of a phone number, check digit of a card, parts of an address).

Defined cases: a null text is scanned as the empty text and has no spans. Repeated rows are
scanned row by row. An empty table gives an empty result. Further columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakework.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]|[\[(]at[\])]|[\[( ]dot[\]) ]", re.I)
_DIGIT = re.compile(r"[0-9]")


# An address in plain words: a name, "at", a name that is no article, and one "dot" or more.
_SPELLED = re.compile(r"\S+\s+at\s+(?!(?:the|an?|this|that|my|our|his|her)\s)\S+(?:\s+dot\s+\S+)+\Z", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _ip_holds(text: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in text.split(".")]
    return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)


def _card_holds(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed expressions, by kind, then by start."""
    spans: list[tuple[str, int, int]] = []
    at, free, before = text.find("@"), 0, 0
    while at >= 0:
        if at >= free:
            floor = max(free, before)
            start = floor + len(text[floor:at].rstrip(_LOCAL))
            match = _DOMAIN.match(text, at) if start < at else None
            if match:
                spans.append(("email", start, match.end()))
                free = match.end()
        before, at = at + 1, text.find("@", at + 1)
    if _DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _ip_holds(m[0])]
        spans += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if _card_holds(m[0])]
        spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return spans


# The labelled table: phrases in which {kind|text} marks personal data.
LABELLED = (
    "please call ( {phone|212) 555 0147} today", "tel {phone|(212) 555-0147} or write", "phone {phone|020 7946 0018} now",
    "call {phone|0151-555-0199} before noon", "fax: {phone|030 5550 177}", "Telefon {phone|030/5550177} ab neun Uhr",
    "ring {phone|555-867-5309} and ask", "mobile {phone|07700 900123} is hers", "tél. {phone|01 99 00 12 34} le matin",
    "llame al {phone|91 555 01 23} por la tarde", "my number is {phone|(303) 555-0188}, thanks", "at {phone|415.555.0133} any time",
    "phone {phone|+1 415 555 0133}", "call {phone|0044 20 7946 0018} soon", "tel. {phone|0800-555-111}",
    "mail {email|anna [at] example.org} first", "write to {email|bob(at)mail.example.com} please", "or {email|carol [at] host [dot] net}",
    "contact {email|dave (at) example.net} at once", "reach {email|eve[at]example.com} there", "schreib an {email|otto [at] post.example.de} bitte",
    "email {email|f.g@example.com} today", "courriel {email|jean@poste.example.fr} merci",
    "host {ip|10.0.0.7} is down", "from {ip|192.168.1.20} port 22", "server {ip|172.16.254.1}", "ping {ip|8.8.8.8} twice",
    "card {card|4111 1111 1111 1111} expired", "pay with {card|5500-0000-0000-0004} now", "Karte {card|4012888888881881} gilt", "number {card|3782 822463 10005}",
    "in 1998 the house was sold", "it cost 1,200 dollars in 2004", "version 1.2.3 was out", "release 10.4.11 of the tool",
    "on 2021-03-04 at 10:30 they met", "the 3rd of 12 parts", "chapter 4, page 127", "about 35 % of 900 people", "12.5 km and 3.75 m",
    "from 1914 to 1918 there was war", "scored 21-14 that day", "it weighs 300 - 400 g", "ISBN 978-3-16-148410-0 is out", "call 911 at once",
    "order no. 55120 was sent", "room 101 is free", "lines 10-20 of file 7", "see @anna and @bob", "mention @team 5 times", "meet me (at) noon",
    "sha 9f86d081884c7d65 is its sum", "id 4711 of 5000 rows", "in 50 of 100 cases, 7 failed", "token 04dbebab91ab85687d33 was lost",
    "between 1 000 and 2 000 people", "add 250 ml, wait 10 min, add 50 g", "flight 747 left at 6.30", "zip 90210 is known", "pages 100 101 102 103",
)
_TOKEN = re.compile(r"\S+")
_CUES = {
    "phone": set("tel tel. telefon phone call ring mobile fax tél. fon number teléfono llame".split()),
    "email": set("mail email e-mail contact write courriel reach correo".split()),
    "ip": set("host server ping ip from port".split()),
    "card": set("card karte carte tarjeta pay visa".split()),
    "at": {"at", "(at)", "[at]"},
    "dot": {"dot", "(dot)", "[dot]"},
}
_CUE_OF = {word: cue for cue, words in _CUES.items() for word in words}
_MARKS = "@.,:;()[]+-/_%#$*'\""

# The rest of the table comes from a rule: carriers with a gap, and forms that fill it. In a form 9 is a
# digit, ~ a number up to 255, & a word, ^ a last part of a domain; cards end in their check digit.
_CARRIERS = (
    "please use {} for this", "it was {} all along", "we found {} in the note", "and then {} again", "the line says {} here", "{} is what she wrote", "he gave us {} last week",
    "das war {} im Text", "voici {} dans le texte", "aquí está {} en el texto", "as noted, {} remains", "see {}, or not",
    "they wrote {} twice", "the old page had {} on it", "{} was in the letter", "man fand {} im Brief", "on a lu {} hier", "dijo {} y nada más", "copy {} from there", "under {} you find it",
)
_CUED = {
    "phone": ("call {} now", "phone {} today", "tel {} please", "fax {} only"), "email": ("mail {} first", "write to {} soon", "contact {} there"),
    "ip": ("server {} failed", "ping {} again", "host {} is up"), "card": ("card {} was used", "pay with {} now", "Karte {} bitte"),
}
_FORMS = {
    "phone": (
        "(999) 999-9999", "999-999-9999", "999.999.9999", "+9 999 999 9999", "+99 99 9999 9999", "0999/999999", "0999 999 999", "09 99 99 99 99", "09999-999999",
        "999) 999 9999",
    ),
    "email": (
        "&@&.^", "&.&@&.^", "& [at] &.^", "&(at)&.^", "&[at]&.^", "& (at) &.^", "& [at] & [dot] ^", "& (at) & dot ^", "& at & dot ^", "& at & dot & dot ^", "&.& [at] &.&.^",
    ),
    "ip": ("~.~.~.~",),
    "card": ("9999 9999 9999 9999", "9999-9999-9999-9999", "9999999999999999", "9999 999999 99999"),
}
# Forms that look like personal data and are none.
_LOOKALIKES = (
    "9999-99-99", "99.99.9999", "99:99", "9.9.99", "99.9", "9,999", "999 - 999", "99-99", "ISBN 999-9-99-999999-9", "no. 99999", "9999999 rows", "9 of 99", "99 % of 999", "page 999",
    "$ 9,999.99", "@&", "@& and @&", "& at &", "& (at) noon", "at the & dot", "& dot &", "version 9.9.9.", "99 km", "a9b99c9", "#9999", "9/9", "999 999 of them", "&-99", "9999 to 9999",
    "9.99E-99",
)
_WORDS = "anna bob carla dora emil frida gina hans ida jon kira lea mona nina olaf paul rita sven tina ulf vera willi mail post info office example sample demo test acme".split()
_ENDS = ("org", "com", "net", "de", "fr", "es", "co", "io")


def fill_form(form: str, rng: np.random.Generator, kind: str = "") -> str:
    """A form with random digits, numbers and words; a card gets the check digit that holds."""
    parts = {"9": lambda: rng.integers(10), "~": lambda: rng.integers(256), "&": lambda: rng.choice(_WORDS), "^": lambda: rng.choice(_ENDS)}
    text = re.sub(r"[9~&^]", lambda m: str(parts[m[0]]()), form)
    if kind == "card":
        text = next(text[:-1] + c for c in "0123456789" if luhn(_digits(text[:-1] + c)))
    return text


def made_phrases(seed: int, each: int, carriers: Sequence[str] = _CARRIERS[::2]) -> list[str]:
    """``each`` labelled phrases of every kind, and as many without personal data, by the rule of the forms."""
    rng, phrases = np.random.default_rng(seed), []
    for kind, forms in _FORMS.items():
        for i in range(each):
            own = (*carriers, *_CUED[kind])
            phrases.append(own[rng.integers(len(own))].format(f"{{{kind}|{fill_form(forms[i % len(forms)], rng, kind)}}}"))
    for i in range(2 * each):
        phrases.append(carriers[rng.integers(len(carriers))].format(fill_form(_LOOKALIKES[i % len(_LOOKALIKES)], rng)))
    return phrases


LABELS = ("none", *(f"{p}-{k}" for k in KINDS for p in ("first", "next")))


def parse_labelled(phrase: str) -> tuple[list[str], list[int]]:
    """Tokens and label numbers of a phrase of the labelled table."""
    plain, marks = "", []
    for part in re.split(r"(\{\w+\|[^}]*\})", phrase):
        match = re.fullmatch(r"\{(\w+)\|([^}]*)\}", part)
        if match:
            marks.append((len(plain), len(plain) + len(match[2]), match[1]))
        plain += match[2] if match else part
    tokens, labels = [], []
    for m in _TOKEN.finditer(plain):
        tokens.append(m[0])
        own = next((x for x in marks if x[0] < m.end() and m.start() < x[1]), None)
        if own is None:
            labels.append(0)
        else:
            inside = len(tokens) > 1 and bool(labels) and m.start() > own[0] and labels[-1] > 0
            labels.append(LABELS.index(f"{'next' if inside else 'first'}-{own[2]}"))
    return tokens, labels


class _Classes(dict):
    """The class of every character: small a, capital A, other letter u, digit 9; others stand for themselves."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "a" if c.islower() else "A" if c.isupper() else "u" if c.isalpha() else "9" if c.isdigit() else c
        return self[point]


_CLASSES = _Classes()
_RUNS = re.compile(r"a{2,}|A{2,}|u{2,}|9{14,}")


def signature(token: str) -> tuple[str, str]:
    """What the features of a token are made of: its character classes, with runs of letters as one, and its cue.

    The whole token is read; runs of digits count up to thirteen.
    """
    return _RUNS.sub(lambda m: m[0][0] if m[0][0] != "9" else "9" * 13, token.translate(_CLASSES)), _CUE_OF.get(token.lower().strip(":,;"), "")


def token_features(token: str) -> tuple[str, ...]:
    return _features(*signature(token))


def _features(classes: str, cue: str) -> tuple[str, ...]:
    """Word shape and what else the signature tells; of a long shape both ends stand for it."""
    shape = re.sub("9+", lambda m: f"9{min(len(m[0]), 9)}", classes.rstrip(".,;:!?"))
    coarse = re.sub("9[0-9]", "9", shape)
    digits = classes.count("9")
    if len(shape) > 40:
        shape, coarse = f"{shape[:20]}~{shape[-20:]}", f"{coarse[:20]}~{coarse[-20:]}"
    marks = "".join(m for m in _MARKS if m in classes)
    amount = "none" if not digits else "few" if digits < 7 else "some" if digits < 16 else "many"
    return (
        f"kind={amount}{''.join(sorted(set(coarse) & set('aAu')))}{marks}", f"start={coarse[:1]}{amount}",
        f"s={shape}", f"c={coarse}", f"d={min(digits, 12)}", f"only={digits == len(classes)}", f"cue={cue}", f"first={coarse[:1]}",
        f"marks={marks}", f"at={'@' in classes or cue == 'at'}", f"in={''.join(b for b in ('[a]', '(a)') if b in classes)}",
    )


def training_phrases() -> list[str]:
    """The labelled table: the phrases above, and those made by the rule from every second carrier."""
    return [*LABELLED, *made_phrases(8, 44)]


class ChainField:
    """Linear-chain conditional random field with observation and transition weights."""

    def __init__(self, phrases: Sequence[str] | None = None, epochs: int = 40, rate: float = 0.4, decay: float = 1e-3) -> None:
        data = [parse_labelled(p) for p in (training_phrases() if phrases is None else phrases)]
        self.index: dict[str, int] = {}
        rows = [[self._numbers(tokens, i, grow=True) for i in range(len(tokens))] for tokens, _ in data]
        n, k = len(self.index), len(LABELS)
        self.weights, self.moves = np.zeros((n, k)), np.zeros((k, k))
        square = (np.full((n, k), 1e-6), np.full((k, k), 1e-6))
        for _ in range(epochs):
            grad, moved = -decay * self.weights, -decay * self.moves
            for ids, (_, gold) in zip(rows, data):
                emit = np.stack([self.weights[i].sum(0) for i in ids])
                node, edge = self._expect(emit)
                for t, i in enumerate(ids):
                    np.subtract.at(grad, i, node[t])
                    np.add.at(grad, (i, gold[t]), 1)
                moved = moved - edge
                for a, b in zip(gold, gold[1:]):
                    moved[a, b] += 1
            for value, g, s in ((self.weights, grad, square[0]), (self.moves, moved, square[1])):
                s += g**2
                value += rate * g / np.sqrt(s)
        self._known: dict[str, int] = {}
        self._alike: dict[tuple[str, str], int] = {}
        self._parts = np.zeros((1, 3, k))

    def _numbers(self, tokens: Sequence[str], i: int, grow: bool = False) -> list[int]:
        around = [("", tokens[i])]
        around += [("-1", tokens[i - 1])] if i else []
        around += [("+1", tokens[i + 1])] if i + 1 < len(tokens) else []
        names = [f"{at}{f}" for at, token in around for f in token_features(token)]
        names += ["start"] if not i else []
        if grow:
            return [self.index.setdefault(x, len(self.index)) for x in names]
        return [self.index[x] for x in names if x in self.index]

    def _expect(self, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of labels and expected moves, by forward-backward."""
        t, k = emit.shape
        ahead, back = np.empty((t, k)), np.zeros((t, k))
        lse = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
        ahead[0] = emit[0]
        for i in range(1, t):
            ahead[i] = emit[i] + lse(ahead[i - 1][:, None] + self.moves, 0)
        for i in range(t - 2, -1, -1):
            back[i] = lse(self.moves + (emit[i + 1] + back[i + 1])[None], 1)
        total = lse(ahead[-1], 0)
        edge = np.zeros((k, k))
        for i in range(1, t):
            edge += np.exp(ahead[i - 1][:, None] + self.moves + (emit[i] + back[i])[None] - total)
        return np.exp(ahead + back - total), edge

    def _part(self, features: Sequence[str]) -> np.ndarray:
        """What a token adds to its own emission, to that of the token before it and of the one after it."""
        ids = ([self.index[x] for x in (f"{at}{f}" for f in features) if x in self.index] for at in ("", "+1", "-1"))
        return np.stack([self.weights[i].sum(0) for i in ids])

    def _lookup(self, tokens: Sequence[str]) -> np.ndarray:
        """Row of every token in the table of parts, one row for all tokens of one signature; row 0 is no token."""
        if len(self._known) > 200_000 or len(self._alike) > 20_000:
            self._known, self._alike, self._parts = {}, {}, self._parts[:1]
        new, parts = [t for t in dict.fromkeys(tokens) if t not in self._known], []
        for token in new:
            alike = signature(token)
            row = self._alike.get(alike)
            if row is None:
                row = self._alike[alike] = len(self._parts) + len(parts)
                parts.append(self._part(_features(*alike)))
            self._known[token] = row
        if parts:
            self._parts = np.concatenate([self._parts, np.stack(parts)])
        return np.fromiter(map(self._known.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, tokens: Sequence[str], lengths: Sequence[int] | None = None) -> np.ndarray:
        """Scores of the labels of every token; ``lengths`` tells where several texts in a row end."""
        rows = self._lookup(tokens)
        ends = np.cumsum(lengths if lengths is not None else [len(tokens)])
        starts = np.concatenate([[0], ends[:-1]])
        before, after = np.concatenate([[0], rows[:-1]]), np.concatenate([rows[1:], [0]])
        before[starts], after[ends - 1] = 0, 0
        out = self._parts[rows, 0] + self._parts[before, 2] + self._parts[after, 1]
        if "start" in self.index:
            out[starts] += self.weights[self.index["start"]]
        return out

    def decode(self, texts: Sequence[Sequence[str]], batch: int = 1 << 17) -> list[np.ndarray]:
        """Best label numbers of every text: Viterbi over batches of about ``batch`` tokens, longest texts first."""
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        first = 0
        while first < len(order):
            stop, held = first, 0
            while stop < len(order) and (stop == first or held + len(texts[order[stop]]) <= batch):
                held += len(texts[order[stop]])
                stop += 1
            own = order[first:stop]
            first = stop
            lengths = np.array([len(texts[i]) for i in own])
            emit = self.emissions([t for i in own for t in texts[i]], lengths)
            starts = np.cumsum(lengths) - lengths
            # Of the texts, longest first, the first live[t] have a token t.
            live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
            scores = [emit[starts].T]
            for t in range(1, lengths[0]):
                ways = scores[-1][:, None, : live[t]] + self.moves[:, :, None]
                scores.append(ways.max(0) + emit[starts[: live[t]] + t].T)
            paths, label = np.zeros(held, np.int64), np.zeros(0, np.int64)
            for t in range(lengths[0] - 1, -1, -1):
                score = scores[t]
                came = (score[:, : len(label)] + self.moves[:, label]).argmax(0)
                label = np.concatenate([came, score[:, len(label) :].argmax(0)])
                paths[starts[: live[t]] + t] = label
            for i, start, n in zip(own, starts, lengths):
                best[i] = paths[start : start + n]
        return best


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in ".,;:!?<>\"'|":
        start += 1
    while end > start and not (text[end - 1].isalnum() or text[end - 1] in "])" and "[" in text[start:end]):
        end -= 1
    return start, end


def _added_holds(kind: str, text: str) -> bool:
    if kind == "phone":
        return 7 <= len(_digits(text)) <= 15 and not re.search(r"[A-Za-z]", text)
    if kind == "card":
        return _card_holds(text)
    if kind == "ip":
        return _ip_holds(text)
    spelled = re.search(r"[\[(\s]dot[\])\s]", text, re.I)
    if re.search(r"[\[(]at[\])]|@", text, re.I):
        return bool(spelled or "." in text)
    return bool(spelled and _SPELLED.match(text))


def find_personal(texts: Sequence[str | None], field: ChainField) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, added spans) of every text."""
    out, owner, words = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        out.append((base_spans(text), []))
        if _MARK.search(text):
            owner.append(i)
            words.append(text.split())
    for i, path in zip(owner, field.decode(words)):
        if not path.any():
            continue
        (base, added), tokens, t = out[i], [m.span() for m in _TOKEN.finditer(texts[i])], 0
        while t < len(tokens):
            if path[t] == 0:
                t += 1
                continue
            kind, stop = LABELS[path[t]].split("-")[1], t + 1
            while stop < len(tokens) and LABELS[path[stop]] == f"next-{kind}":
                stop += 1
            start, end = _trim(texts[i], tokens[t][0], tokens[stop - 1][1])
            apart = all(end <= s or e <= start for _, s, e in base)
            if start < end and apart and _added_holds(kind, texts[i][start:end]):
                added.append((kind, start, end))
            t = stop
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_personal_data(docs: DataFrame, field: ChainField | None = None, column: str = "personal") -> DataFrame:
    """All columns of ``docs`` and the spans of ``text`` as an array of (kind, start, end, base)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or ChainField())
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != column))
    schema = docs.select("*", F.lit(None).cast(SPANS).alias(column)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                rows = []
                for base, added in find_personal(texts, shared.value):
                    spans = [(*s, True) for s in base] + [(*s, False) for s in added]
                    spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                    rows.append([{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind)], [*part.schema.names, column])

    return docs.mapInArrow(run, schema)


def digest_of_spans(spans: Sequence[tuple[str, int, int]]) -> str:
    """What ``base_sha256`` holds, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), column="found").drop("text")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    base = F.filter("found", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        (F.size("found") - F.size(base)).cast("long").alias("n_added"), F.size("found").cast("long").alias("n_spans"),
    )
