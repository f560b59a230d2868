"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss."""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# --- fixed patterns ----------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: a number with dots starts where no digit stands before it, which keeps long rows of digits linear
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From every ``@``, left over the local part and right over the domain."""
    end = 0
    at = text.find("@")
    while at >= 0:
        low = at
        while low > end:  # back in steps, so that only the local part itself is looked at
            part = text[max(end, low - 64):low]
            kept = _LOCAL.search(part)
            size = len(kept[0]) if kept else 0
            low -= size
            if size < len(part):
                break
        if low < at and (m := _DOMAIN.match(text, at)):
            yield low, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find and the checks of its kind pass: ``(kind, start, end)``, by kind, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- the labelled table: fixed values ----------------------------------------------

#: sentences in which <kind words> marks personal data; the rest, among it many numbers that are none, is plain
LABELLED = """
write to <email anna.berg@mail.example.com> before noon
my address is <email j_doe99@example.org> and I answer soon
mail <email office (at) example.com> for the papers
ask <email lena [at] example.net> or come by
send it to <email max(at)example.com> please
reach us at <email info[at]shop.example.org> any day
the host <ip 192.168.10.7> did not answer
we saw <ip 10.0.0.254> in the log again
login from <ip 203.0.113.77> was refused
paid with card <card 4111 1111 1111 1111> last week
the number <card 5500-0055-5555-5559> is blocked
charge <card 378282246310005> for the room
use <card 4012888888881881> this time
call <phone +1 (212) 555-0147> after six
my phone is <phone +49 30 901820> at work
ring <phone +33 1 70 18 99 00> and wait
tel <phone (040) 555-0631> is hers
phone <phone (212) 555-0199> for a table
call <phone 040-555-0631> or write
their line <phone 212-555-0188> was busy
tel <phone 030/901820> only in the morning
call me at <phone 0171 5550123> tonight
phone <phone 555-867-5309> is a song
dial <phone (09) 555-6973> for help
the year 2019 was warm and dry
she is 42 and he is 7 years old
it costs 1,299.00 with tax
about 3.5 percent of 12000 people came
version 2.0 of the licence applies
see section 4.2.1 on page 118
the build 10.15.7 is out since May
order 2353820953013749 was sent
the file 0981723498712 holds nothing
id 88213 and id 99120 are free
from 2001-09-11 to 2003-05-01 it was closed
on 12/05/2021 at 10:30 we met
a9ce335683f9772ddc is the key of the box
row 17 has 20 seats and 3 doors
the ratio 16:9 is common on 4k screens
chapter 12 begins on the 3rd of May
between 1914 and 1918 there was war
100 200 300 400 is a row of numbers
1 2 3 4 5 6 7 8 9 10
sum of 123456789 and 987654321
the part 7781-A fits the 7781-B
he wrote @home and left
at noon we met at the gate
call them when the phone rings
the mail came at last and the card too
a dozen words without any number in them at all
It was late. The rain had stopped, and nobody came.
They said: stay here; we go on!
Der Hund lief weit, und niemand rief ihn.
""".strip().splitlines()

_TOKEN = re.compile(r"\S+")
_ODD = re.compile(r"[0-9@]+|[(\[]at[)\]]")
_EDGE = " .,;:!?\"'"
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
CUES = {"call", "tel", "phone", "dial", "ring", "mail", "email", "card", "host", "ip", "(at)", "[at]", "at"}


def shape(token: str) -> str:
    """Letters as x and X, runs of them as one; digits as their number; other characters as they are."""
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0][0].isupper() else "x", token[:64])
    return re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 9)}", s)


def features(tokens: Sequence[str], i: int) -> list[str]:
    """Shapes of a token and its neighbours; words themselves count only if they are cues."""
    core = tokens[i].strip(_EDGE)
    s = shape(core)
    digits = re.sub(r"\D", "", core[:64])
    out = ["bias", f"s={s}", f"k={re.sub('[0-9]', '', s)}", f"n={min(len(digits), 20)}", f"@={'@' in core}", f"edge={tokens[i][-1:] in '.,;:!?'}"]
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if core.count(".") == 3 and s.count("d") == 4:
        out.append("quad")
    for j, name in ((i - 2, "p2"), (i - 1, "p"), (i + 1, "f"), (i + 2, "f2")):
        near = tokens[j].strip(_EDGE) if 0 <= j < len(tokens) else ""
        if any(c.isdigit() or c == "@" for c in near):
            out.append(f"{name}={re.sub('[0-9]', '', shape(near))}")
        if near.lower() in CUES:
            out.append(f"{name}w={near.lower()}")
    if core.lower() in CUES:
        out.append(f"w={core.lower()}")
    return out


def parse(sentence: str) -> tuple[list[str], list[str]]:
    """Tokens and labels of a marked sentence."""
    tokens, labels = [], []
    for m in re.finditer(r"<(\w+) ([^>]+)>|(\S+)", sentence):
        if m[3]:
            tokens.append(m[3])
            labels.append("O")
        else:
            for k, t in enumerate(m[2].split()):
                tokens.append(t)
                labels.append(f"{'I' if k else 'B'}-{m[1]}")
    return tokens, labels


# --- the model -----------------------------------------------------------------------

@dataclass(frozen=True)
class Field:
    names: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def unary(self, tokens: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(LABELS)))
        for i in range(len(tokens)):
            out[i] = self.weights[[self.names[f] for f in features(tokens, i) if f in self.names]].sum(axis=0)
        return out

    def neutral(self) -> bool:
        """Whether a plain word between plain words is outside in some best path, whatever stands farther off.

        Its margin for the outside label must be worth any change of the two moves next to it.
        """
        plain = [self.unary([w] * 5)[2] for w in ("word", "Word", "word,", "Word.")]
        margin = min(u[0] - u[1:].max() for u in plain)
        return bool(margin >= 2 * (self.moves[_ALLOWED].max() - self.moves[_ALLOWED].min()))

    def decode(self, rows: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of many rows of unary scores: rows of similar length go together as one array."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        moves = np.where(_ALLOWED, self.moves, -1e9)
        for low in range(0, len(order), 512):
            own = order[low:low + 512]
            lengths = np.array([len(rows[i]) for i in own])
            if not lengths.max(initial=0):
                continue
            table = np.zeros((len(own), lengths.max(), len(LABELS)))
            for r, i in enumerate(own):
                table[r, :len(rows[i])] = rows[i]
            best, back = table[:, 0] + np.where(_STARTS, 0.0, -1e9), []
            for t in range(1, table.shape[1]):
                ways = best[:, :, None] + moves[None]
                back.append(ways.argmax(axis=1))
                step = ways.max(axis=1) + table[:, t]
                best = np.where((t < lengths)[:, None], step, best)
            path = np.zeros((len(own), table.shape[1]), int)
            label = best.argmax(axis=1)
            for t in range(table.shape[1] - 1, -1, -1):
                path[:, t] = label
                if t:
                    label = np.where(t < lengths, back[t - 1][np.arange(len(own)), label], label)
            for r, i in enumerate(own):
                out[i] = path[r, :lengths[r]]
        return out


#: an inside label follows a label of its own kind
_ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
_STARTS = np.array([not b.startswith("I-") for b in LABELS])


def fit(table: Sequence[tuple[list[str], list[str]]], rounds: int = 250, penalty: float = 0.01, step: float = 0.5) -> Field:
    """Maximum likelihood by gradient steps of adapted size; all sentences are one padded array."""
    names: dict[str, int] = defaultdict(lambda: len(names))
    coded = [[[names[f] for f in features(t, i)] for i in range(len(t))] for t, _ in table]
    longest, n, y = max(map(len, coded)), len(coded), len(LABELS)
    lengths = np.array([len(c) for c in coded])
    gold = np.zeros((n, longest), int)
    rows, cols, ids = [], [], []
    for r, (sentence, (_, labels)) in enumerate(zip(coded, table, strict=True)):
        gold[r, :len(labels)] = [LABELS.index(x) for x in labels]
        for c, own in enumerate(sentence):
            rows += [r] * len(own)
            cols += [c] * len(own)
            ids += own
    rows, cols, ids = map(np.array, (rows, cols, ids))
    live = np.arange(longest) < lengths[:, None]
    seen = np.zeros((n, longest, y))
    seen[np.nonzero(live)[0], np.nonzero(live)[1], gold[live]] = 1
    pairs = np.zeros((y, y))
    np.add.at(pairs, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
    weights, moves = np.zeros((len(names), y)), np.zeros((y, y))
    size_w, size_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    for _ in range(rounds):
        u = np.zeros((n, longest, y))
        np.add.at(u, (rows, cols), weights[ids])
        t = np.where(_ALLOWED, moves, -1e9)
        forward = np.zeros((n, longest, y))
        forward[:, 0] = u[:, 0] + np.where(_STARTS, 0, -1e9)
        for k in range(1, longest):
            forward[:, k] = np.logaddexp.reduce(forward[:, k - 1, :, None] + t, axis=1) + u[:, k]
        backward = np.zeros((n, longest, y))
        for k in range(longest - 2, -1, -1):
            ahead = np.logaddexp.reduce(t + (u[:, k + 1] + backward[:, k + 1])[:, None, :], axis=2)
            backward[:, k] = np.where(live[:, k + 1, None], ahead, 0)
        whole = np.logaddexp.reduce(forward[np.arange(n), lengths - 1], axis=1)
        expected = np.exp(forward + backward - whole[:, None, None]) * live[:, :, None]
        both = np.zeros((y, y))
        for k in range(1, longest):
            joint = np.exp(forward[:, k - 1, :, None] + t + (u[:, k] + backward[:, k])[:, None, :] - whole[:, None, None])
            both += (joint * live[:, k, None, None]).sum(axis=0)
        gap = seen - expected
        grad_w = np.zeros_like(weights)
        np.add.at(grad_w, ids, gap[rows, cols])
        grad_w -= penalty * weights
        grad_m = np.where(_ALLOWED, pairs - both, 0) - 4 * penalty * moves
        size_w += grad_w ** 2
        size_m += grad_m ** 2
        weights += step * grad_w / np.sqrt(size_w)
        moves += step * grad_m / np.sqrt(size_m)
    return Field(dict(names), weights, moves)


def model_spans(field: Field, texts: Sequence[str], whole: bool = False) -> list[list[tuple[str, int, int]]]:
    """Spans that the field labels in each text.

    With a neutral field the row of tokens is cut where a best path is known to be outside: only tokens within three of
    one with a digit, an ``@`` or a written-out ``at`` are decoded, with the same result as the whole row (words of
    over 200 characters are cut there).
    """
    rows, places = [], []
    for n, text in enumerate(texts):
        if whole:
            parts = [(0, len(text))] if text else []
        else:
            parts, reached = [], -1
            for m in _ODD.finditer(text):
                low, high = m.span()
                if high <= reached:  # inside the last window's inner part
                    continue
                for k in range(4):
                    low = max(0, text.rfind(" ", max(0, low - 200), low), low - 200)
                    nxt = text.find(" ", high + 1, high + 200)
                    high = nxt if nxt >= 0 else min(len(text), high + 200)
                    reached = high if not k else reached
                if parts and low <= parts[-1][1]:
                    parts[-1] = (parts[-1][0], max(high, parts[-1][1]))
                else:
                    parts.append((low, high))
        for low, high in parts:
            found = [(m[0], low + m.start()) for m in _TOKEN.finditer(text[low:high])]
            if found:
                rows.append(field.unary([t for t, _ in found]))
                places.append((n, found))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for (n, found), path in zip(places, field.decode(rows), strict=True):
        open_ = None
        for (token, at), label in zip(found, [LABELS[k] for k in path], strict=True):
            low = at + len(token) - len(token.lstrip(_EDGE))
            high = at + len(token.rstrip(_EDGE))
            if label.startswith("B-"):
                open_ = [label[2:], low, high]
                out[n].append(open_)
            elif label.startswith("I-") and open_:
                open_[2] = high
            else:
                open_ = None
    return [[(k, a, b) for k, a, b in own if b > a] for own in out]


def all_spans(field: Field, texts: Sequence[str], whole: bool = False) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text what the patterns find, and what the field adds beside it."""
    out = []
    for text, added in zip(texts, model_spans(field, texts, whole), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        out.append((base, [s for s in added if not any(a < s[2] and s[1] < b for a, b in taken)]))
    return out


_SPAN = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def train(spark: SparkSession, sentences: Sequence[str] = LABELLED) -> Field:
    """The field, fitted to a small table of labelled sentences on the driver."""
    table = spark.createDataFrame([(s,) for s in sentences], "sentence string")
    return fit([parse(r["sentence"]) for r in table.collect()])


def find(docs: DataFrame, sentences: Sequence[str] = LABELLED) -> DataFrame:
    """Personal data in every text: ``doc_id, spans``, each with kind, start, end (code points) and whether a pattern found it.

    The patterns' spans always stay; the field adds those that overlap none of them.  Spans are ordered by kind as in
    ``KINDS``, then start.  Null and empty texts have none; every row gives one row.
    """
    field = train(docs.sparkSession, sentences)
    model = docs.sparkSession.sparkContext.broadcast((field, not field.neutral()))

    @F.pandas_udf(_SPAN)
    def spans(texts: pd.Series) -> pd.Series:
        own, whole = model.value
        rows = []
        for base, added in all_spans(own, [t or "" for t in texts], whole):
            marked = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in added]
            marked.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            rows.append([{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in marked])
        return pd.Series(rows, dtype=object)

    return docs.select("doc_id", spans("text").alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the spans as text, with a checksum of the patterns' own."""
    def joined(only_base: bool):
        own = F.filter("spans", lambda s: s["base"]) if only_base else F.col("spans")
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", functools.partial(lambda k, s: s["base"] & (s["kind"] == k), k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(True).cast("binary"), 256).alias("base_sha256"), joined(False).alias("spans"))
