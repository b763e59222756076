"""Operator 5: personal data by a linear-chain conditional random field over word-shape features.

Four base patterns with their checks always hold. The field adds spans that they miss (a phone number without
its plus sign, an address whose @ is written out, a card number with dots): it is trained on the small labelled
table below and decoded by Viterbi in numpy batches. Its sequences are the runs of white-space separated words within
``SIDE`` words of one that holds a digit, an @ or a written-out @ outside the base spans; all other words have the label
"none", for every labelled span holds such a sign. Runs and words may be of any length. An added span never overlaps a
base span.

Null and empty texts have no spans. Repeated rows give one row each. Long texts are read whole, in linear time, one long
line too. Further columns aren't read; ``redact`` keeps them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: The labelled table: words and, after a bar, their kind; words without one have none.
LABELLED = """
call me at (415)|phone 555-2671|phone before noon
phone 415-555-2671|phone or write
tel. 030|phone 1234|phone 5678|phone ab neun Uhr
Tel: 020-7946-0958|phone today
my number is 415.555.0132|phone thanks
téléphone 01|phone 42|phone 68|phone 53|phone 00|phone le matin
llame al (912)|phone 345-678|phone mañana
rufen Sie (0171)|phone 555-1234|phone an
fax (212)|phone 555-0187|phone only
reach us on 800-555-0199|phone any day
send it to sam|email at|email place|email dot|email org|email today
mail eva|email at|email work|email dot|email net|email please
write to john|email at|email example|email dot|email com|email please
mail an anna|email at|email beispiel|email dot|email de bitte
contact jane(at)example.org|email now
contact jane[at]example.com|email soon
kontakt max(at)beispiel.de|email heute
envoyez à luc[at]exemple.fr|email merci
mobil 0171|phone 2345|phone 6789|phone ab morgen
mobile 0161|phone 496|phone 0123|phone in the evening
(646)|phone 555-0123|phone
ask for tim(at)corp.example.com|email tomorrow
write kim(at)site.co.uk|email now
ann(at)example.org|email
lea[at]mail.example.net|email
joe{at}example.com|email is mine
schreib an ute[at]post.beispiel.de|email bald
mail tom|email at|email server|email dot|email com|email
write to ida|email at|email uni|email dot|email edu|email today
room at the inn was dot matrix
the shop at number 7 was shut
we met at noon (at least) twice
card 4111.1111.1111.1111|card expires soon
Karte 5500.0000.0000.0004|card gültig
tarjeta 4012.8888.8888.1881|card vence
pay with 4111/1111/1111/1111|card today
host 10-0-0-12|ip answered
server 192,168,0,7|ip is down
address 172[.]16[.]0[.]9|ip was seen
gateway 10[.]1[.]2[.]3|ip replied
in 1984 the book sold 12,000 copies
the year 2020 had 366 days
version 3.11.2 was released on 2024-01-15
chapter 4 section 12 page 345
at 10:30 on 12/05/2021 we met
it cost $1,299.99 in total
Licensed under the Apache License, Version 2.0.
the GNU General Public License, version 3.
Licensed under CC BY-NC 4.0.
er hat 25 Jahre und 1.234,50 Euro
le 14 juillet 1789 à Paris
tiene 300 páginas y 12 capítulos
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" in the file
key "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" was lost
the order 20231 has 3 items
scores were 3-2 and 10-9 at the end
room 12-34 on floor 5
see RFC 2616 and ISO 8601
@ the office we talk
follow @someone for news
temperatures of 36.6 and 40.2
from 1914-1918 and 1939-1945
2 + 2 = 4 and 3 x 3 = 9
invoice 1234567 was paid
population 8,500,000 in 2019
iPhone 12 and Windows 10
"""

SEPARATED = re.compile(r"[(\[{]at[)\]}]", re.I)
#: Words that make a number or a name next to them likelier to be personal data: a feature of the field.
CUES = frozenset("tel tel. tel: phone phone: call fax number nummer téléphone teléfono telefon mobile cell mail email e-mail write contact kontakt card karte tarjeta carte host server address gateway ip".split())
SIDE = 5
SIDES, SIGNS = (-2, -1, 1, 2), ("at", "dot")
RUN = re.compile(r"(?:\.[Aa]+)+")


def base(text: str) -> list[tuple[int, int, int]]:
    """The base spans (start, kind's number, end), by start and kind."""
    out = []
    at, last, cut = text.find("@"), 0, 0
    while at >= 0:
        begin = max(last, cut)
        start = begin + len(text[begin:at].rstrip(LOCAL))
        cut = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(cut, last))
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def shape(word: str) -> str:
    """Classes of characters, runs of letters shortened: (415) is (ddd), Hello is Aa."""
    out: list[str] = []
    for c in word:
        k = "d" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if k == "d" or not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def own_features(word: str) -> list[str]:
    """What a word is by itself: its shape, digits, marks, written-out signs."""
    bare = word.strip(".,;:!?\"'")
    own, low = shape(bare), bare.lower()
    kind = re.sub("d+", "d", own)
    out = ["bias", f"shape={own}", f"digits={min(sum('0' <= c <= '9' for c in bare), 17)}", f"kind={kind}", f"run={RUN.sub('.a', kind)}", f"dots={bare.count('.')}", f"marks={''.join(sorted(set(c for c in own if c not in 'dAa')))}"]
    if low in SIGNS or SEPARATED.search(low):
        out.append(f"sign={low if low in SIGNS else 'in'}")
    if low in CUES:
        out.append("cue")
    return out


def side_features(word: str, side: int) -> list[str]:
    """What a word is to the one ``side`` places before it; "" beyond the ends."""
    low = word.lower().strip(".,;:!?\"'")
    out = [f"{side}:{re.sub('d+', 'd', shape(word.strip('.,;:!?')))}"]
    if low in CUES or low in SIGNS:
        out.append(f"{side}:cue={low if low in SIGNS else 'x'}")
    return out


def features(words: list[str], k: int) -> list[str]:
    """The features of the k-th of some words: its own and those of the two words on each side."""
    return own_features(words[k]) + [f for side in SIDES for f in side_features(words[k + side] if 0 <= k + side < len(words) else "", side)]


class Field:
    """A linear-chain conditional random field; label 0 is "none"."""

    def __init__(self, rows: list[tuple[list[str], list[int]]], *, rounds: int = 150, decay: float = 0.02) -> None:
        names = sorted({f for words, _ in rows for k in range(len(words)) for f in features(words, k)})
        self.index = {f: k for k, f in enumerate(names)}
        n = len(KINDS) + 1
        self.known: dict[str, np.ndarray] = {}
        self.emit, self.move = np.zeros((len(names), n)), np.zeros((n, n))
        data = [([[self.index[f] for f in features(words, k)] for k in range(len(words))], np.array(labels)) for words, labels in rows]
        first, second = np.zeros(self.emit.size + n * n), np.zeros(self.emit.size + n * n)
        for step in range(1, rounds + 1):
            grad_emit, grad_move = -decay * self.emit, -decay * self.move
            for at, labels in data:
                score = np.array([self.emit[x].sum(0) for x in at])
                forward, backward = [score[0]], [np.zeros(n)]
                for s in score[1:]:
                    forward.append(s + np.logaddexp.reduce(forward[-1][:, None] + self.move, axis=0))
                for s in score[:0:-1]:
                    backward.append(np.logaddexp.reduce(self.move + (s + backward[-1])[None, :], axis=1))
                backward = backward[::-1]
                total = np.logaddexp.reduce(forward[-1])
                for k, x in enumerate(at):
                    p = -np.exp(forward[k] + backward[k] - total)
                    p[labels[k]] += 1
                    grad_emit[x] += p
                    if k:
                        grad_move -= np.exp(forward[k - 1][:, None] + self.move + (score[k] + backward[k])[None, :] - total)
                        grad_move[labels[k - 1], labels[k]] += 1
            grad = np.r_[grad_emit.ravel(), grad_move.ravel()]
            first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
            move = 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.emit += move[: self.emit.size].reshape(self.emit.shape)
            self.move += move[self.emit.size :].reshape(n, n)

    def weigh(self, words: list[str]) -> np.ndarray:
        """Per word its own weights by label, and those it has for the words around it: (words, 1 + sides, labels)."""
        out = np.zeros((len(words), 1 + len(SIDES), self.move.shape[0]))
        for k, word in enumerate(words):
            if (known := self.known.get(word)) is None:
                known = np.stack([self.emit[[self.index[f] for f in some if f in self.index]].sum(0) for some in (own_features(word), *(side_features(word, side) for side in SIDES))])
                if len(self.known) < KNOWN and len(word) <= 40:
                    self.known[word] = known
            out[k] = known
        return out

    def decode(self, windows: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each window; windows of about one length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(windows)
        order = sorted(range(len(windows)), key=lambda k: len(windows[k]))
        n = self.move.shape[0]
        first = 0
        while first < len(order):
            group = order[first : first + 256]
            while len(group) > 1 and len(group) * len(windows[group[-1]]) > CELLS:
                group = group[: len(group) // 2]
            first += len(group)
            ends = np.array([len(windows[k]) for k in group])
            longest = int(ends[-1])
            names: dict[str, int] = {"": 0}
            place = np.zeros((len(group), longest + 4), np.int32)  # two empty words at each end
            for row, k in enumerate(group):
                place[row, 2 : 2 + ends[row]] = [names.setdefault(w, len(names)) for w in windows[k]]
            weight = self.weigh(list(names))
            score = weight[place[:, 2 : 2 + longest], 0]
            for j, side in enumerate(SIDES):
                score += weight[place[:, 2 + side : 2 + side + longest], 1 + j]
            best, back = score[:, 0], np.zeros((len(group), longest, n), np.int8)
            for t in range(1, longest):
                step = best[:, :, None] + self.move[None]
                back[:, t] = step.argmax(1)
                best = np.where((t < ends)[:, None], step.max(1) + score[:, t], best)
            label = best.argmax(1)
            path = np.zeros((len(group), longest), np.int64)
            for t in range(longest - 1, -1, -1):
                path[:, t] = label
                label = np.where((t < ends) & (t > 0), back[np.arange(len(group)), t, label], label)
            for row, k in enumerate(group):
                out[k] = path[row, : len(windows[k])]
        return out


@lru_cache(maxsize=1)
def field() -> Field:
    """The field that ``LABELLED`` gives."""
    number = {k: i + 1 for i, k in enumerate(KINDS)}
    rows = []
    for line in LABELLED.strip().splitlines():
        pairs = [w.rsplit("|", 1) if "|" in w else [w, ""] for w in line.split(" ")]
        rows.append(([w for w, _ in pairs], [number.get(k, 0) for _, k in pairs]))
    return Field(rows)


TRIGGER = re.compile(r"[0-9]+|@|[(\[{][aA][tT][)\]}]| [aA][tT] (?=\S+ [dD][oO][tT] )")
WORD = re.compile(r"\S+")
#: Words of the sequences that are decoded at the same time, padded to one length; a longer sequence is decoded alone.
CELLS = 1 << 16
#: Short words whose weights a worker remembers.
KNOWN = 100_000


class Cover:
    """Which places some spans (start, kind, end) hold."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts = [a for a, _, _ in spans]
        self.ends = list(accumulate((b for _, _, b in spans), max))

    def overlaps(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a


def windows(text: str, taken: Cover) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) within ``SIDE`` words of those that may be personal data and that no base span holds."""
    marks = [m.end() - 1 if m[0][-1] != " " else m.start() + 1 for m in TRIGGER.finditer(text) if not taken.overlaps(m.start(), m.end())]
    if not marks:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    starts = [a for a, _ in words]
    out: list[list[tuple[int, int]]] = []
    done = 0
    for at in marks:
        k = bisect_right(starts, at) - 1
        first, last = max(k - SIDE, done if out else 0, 0), min(k + SIDE + 1, len(words))
        if last <= done:
            continue
        if out and first == done and k - SIDE <= done:
            out[-1] += words[done:last]
        else:
            out.append(words[first:last])
        done = last
    return out


def added(texts: list[str], found: list[list[tuple[int, int, int]]], own: Field) -> list[list[tuple[int, int, int]]]:
    """The field's spans of each text that overlap no base span."""
    covers = [Cover(spans) for spans in found]
    where = [(k, words) for k, text in enumerate(texts) for words in windows(text, covers[k])]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    labels = own.decode([[texts[k][a:b] for a, b in words] for k, words in where])
    for (k, words), got in zip(where, labels, strict=True):
        t = 0
        while t < len(words):
            end = t + 1
            while end < len(words) and got[end] == got[t]:
                end += 1
            if got[t]:
                a, b = words[t][0], words[end - 1][1]
                span = texts[k][a:b]
                a += len(span) - len(span.lstrip("\"'.,;:!?|"))
                b -= len(span) - len(span.rstrip("\"'.,;:!?|*#$%&"))
                if a < b and not covers[k].overlaps(a, b):
                    out[k].append((a, int(got[t]) - 1, b))
            t = end
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the numbers of base spans, the digest of the base spans, and all spans."""
    own = field()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            found = [base(t) for t in texts]
            more = added(texts, found, own)
            counts = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(listed(x).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests), pa.array([listed(sorted(a + b)) for a, b in zip(found, more, strict=True)])], names=[f.name for f in schema])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; a null text stays null."""
    at, own = docs.columns.index(text_col), field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [base(t or "") for t in texts]
            more = added([t or "" for t in texts], found, own)
            out = []
            for text, spans in zip(texts, (sorted(a + b) for a, b in zip(found, more, strict=True)), strict=True):
                if not spans:
                    out.append(text)
                    continue
                pieces, end = [], 0
                for a, k, b in spans:
                    if b > end:  # spans of two kinds may overlap: what they hold goes together
                        pieces += [text[end:a], f"[{KINDS[k].upper()}]"] if a >= end else []
                        end = b
                out.append("".join([*pieces, text[end:]]))
            columns = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
