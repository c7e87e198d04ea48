"""Personal data by weak supervision.

Patterns propose spans; labelers (pattern checks, gazetteers, context, shape) vote on each of them or abstain.
Expectation-maximisation over the counts of vote patterns, which are few whatever the size of
the corpus, estimates how reliable each labeler is and how likely each pattern is personal data; a
logistic classifier of votes, kind and length, trained on those likelihoods, makes the final decision.
Spans of the base rules always stay; the classifier adds others.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, written
from .words import text_column

#: Kinds in the order in which spans with equal starts are listed; the last is only found by the method.
KINDS = ("email", "ip", "card", "phone", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Proposals beyond the base rules.
_MORE = {
    "email": re.compile(r"[\[(]at[\])]\s?[A-Za-z0-9-]+(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z0-9-]+)+"),  # from the sign on
    "phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"),
}
#: Gazetteers.
_TOP = frozenset("com org net edu gov io info biz example de fr es uk us it nl eu".split())
_PREFIX = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
_COUNTRY = ("+1", "+33", "+34", "+39", "+44", "+49", "+52", "+61", "+81", "+86", "+91")
#: Context before a span that speaks for a kind, and for none.
_FOR = {
    "email": re.compile(r"(?i)(?:e-?mail|contact|write|reach|correo|adresse|kontakt|mailto)\W*(?:\w+\W+){0,2}$"),
    "ip": re.compile(r"(?i)(?:\bip\b|host|server|address|client|from|adresse)\W*(?:\w+\W+){0,2}$"),
    "card": re.compile(r"(?i)(?:card|visa|master|credit|karte|carte|tarjeta|pay)\w*\W*(?:\w+\W+){0,2}$"),
    "phone": re.compile(r"(?i)(?:phone|tel|call|mobile|fax|telefon|m[oó]vil|appel)\w*\W*(?:\w+\W+){0,2}$"),
    "secret": re.compile(r"(?i)(?:token|secret|passw\w*|api.?key|key|bearer|credential)\W{0,4}$"),
}
_AGAINST = re.compile(r"(?i)(?:version|isbn|issn|order|item|page|section|chapter|no\.|nr\.|build|release|sku|doi)\W*$")
LABELERS = ("rule", "gazetteer", "context", "against", "edges", "shape")
_CONTEXT = 32


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _local(text: str, at: int, done: int) -> int:
    """Where the letters of a local part that end at a place begin, not before `done`."""
    while at > done and text[at - 1] in _LOCAL:
        at -= 1
    return at


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @ back over letters of a local part, not into the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = _local(text, at, done)
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def written_out(text: str) -> Iterator[tuple[int, int]]:
    """Addresses whose sign is written as (at) or [at], with a blank on either side at most."""
    done = 0
    for m in _MORE["email"].finditer(text):
        end = m.start() - (text[m.start() - 1 : m.start()].isspace())
        begin = _local(text, end, done)
        if begin < end:
            yield begin, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by start and kind; what fails its check is dropped without a second try."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_DIGIT, _LETTER, _DIGITS = re.compile("[0-9]"), re.compile("[A-Za-z]"), frozenset("0123456789")


class _Taken:
    """Spans, of which those given first may overlap, and whether another span overlaps any: by binary searches."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.own = [a for a, _ in spans], [b for _, b in spans]
        self.ends = list(accumulate(self.own, max))
        self.added: list[tuple[int, int]] = []  # free of overlaps

    def add(self, a: int, b: int, around: bool = False) -> bool:
        """Take a span unless it overlaps one that is taken; around: it may hold whole ones of those given first."""
        k, n = bisect_left(self.starts, a if around else b), bisect_left(self.added, (b,))
        if k and self.ends[k - 1] > a or n and self.added[n - 1][1] > a:
            return False
        if around and any(end > b for end in self.own[k : bisect_left(self.starts, b)]):
            return False
        insort(self.added, (a, b))
        return True


def proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans beside the base ones, of kinds in this order: email, secret, card, phone. None overlaps one before it or a base
    one, but that a secret, of letters and digits, may hold base ones."""
    taken = _Taken([(a, b) for a, _, b in base])
    found: list[tuple[str, int, int]] = []
    if "at)" in text or "at]" in text:
        found += [("email", a, b) for a, b in written_out(text)]
    if _DIGIT.search(text):
        found += [("secret", *m.span()) for m in _MORE["secret"].finditer(text) if _DIGIT.search(m.group()) and _LETTER.search(m.group())]
        found += [("card", *m.span()) for m in _CARD.finditer(text) if 12 <= sum(c in _DIGITS for c in m.group()) <= 19]
        found += [("phone", *m.span()) for m in _MORE["phone"].finditer(text)]
    return sorted((a, KINDS.index(kind), b) for kind, a, b in found if taken.add(a, b, kind == "secret"))


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote for each labeler: 1 for, 0 against, -1 abstains."""
    name, span = KINDS[kind], text[start:end]
    before = text[max(0, start - _CONTEXT) : start]
    digits = "".join(c for c in span if c in _DIGITS)
    rule = 1 if base else -1 if name in ("secret", "email") else 0
    if name == "email":
        listed = 1 if span.lower().rstrip(" )]").rpartition(".")[2].strip() in _TOP else -1
    elif name == "card":
        listed = 1 if digits.startswith(_PREFIX) else 0
    elif name == "phone":
        listed = 1 if span.startswith(_COUNTRY) or "555" in digits else -1
    elif name == "ip":
        listed = 0 if digits.startswith("0") else -1
    else:
        listed = 1 if re.fullmatch(r"[0-9a-f]{32,}", span) else -1
    near = 1 if _FOR[name].search(before) else -1
    against = 0 if _AGAINST.search(before) else -1
    outside = text[start - 1 : start] + text[end : end + 1]
    edges = 0 if any(c.isalnum() or c == "_" for c in outside) else 1
    if name == "secret":
        shape = 1 if len(set(span)) >= 10 and len(span) >= 32 else 0
    elif name == "card":
        shape = 1 if len(digits) in (15, 16) and len(set(digits)) >= 5 else 0
    else:
        shape = 1 if len(span) >= 7 else 0
    return rule, listed, near, against, edges, shape


def em(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 100) -> dict[tuple[int, tuple[int, ...]], float]:
    """Likelihood of personal data for each (kind, votes): two classes, labelers independent given the class.

    Reliabilities start at 0.8 and are estimated over all kinds together, the share of each kind on its own;
    one pseudo-count keeps them off 0 and 1.
    """
    keys = sorted(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k[0] for k in keys])
    vote = np.array([k[1] for k in keys])
    right = np.full((2, vote.shape[1]), 0.8)  # P(vote 1 | true), P(vote 0 | false)
    share = np.full(len(KINDS), 0.5)
    post = np.full(len(keys), 0.5)
    for _ in range(rounds):
        yes = np.where(vote == 1, np.log(right[0]), np.where(vote == 0, np.log(1 - right[0]), 0)).sum(1) + np.log(share[kind])
        no = np.where(vote == 0, np.log(right[1]), np.where(vote == 1, np.log(1 - right[1]), 0)).sum(1) + np.log(1 - share[kind])
        fresh = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
        moved = np.abs(fresh - post).max()
        post = fresh
        for k in range(len(KINDS)):
            here = kind == k
            share[k] = (1 + (n * post)[here].sum()) / (2 + n[here].sum())
        for c, weight in enumerate((n * post, n * (1 - post))):
            said = np.array([(weight[vote[:, j] == 1 - c]).sum() for j in range(vote.shape[1])])
            spoke = np.array([(weight[vote[:, j] >= 0]).sum() for j in range(vote.shape[1])])
            right[c] = np.clip((4 + said) / (5 + spoke), 0.5, 0.99)  # a labeler is never taken for a liar
        if moved < 1e-6:
            break
    return dict(zip(keys, post.tolist(), strict=True))


def _row(kind: int, vote: tuple[int, ...], size: int) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *(float(v == 1) for v in vote), *(float(v == 0) for v in vote), size / 8]


def classifier(counts: dict[tuple[int, tuple[int, ...], int], int]) -> list[float]:
    """Weights of the span classifier, trained on the likelihoods of (kind, votes, size class) with their counts."""
    merged: dict[tuple[int, tuple[int, ...]], int] = {}
    for (kind, vote, _), n in counts.items():
        merged[kind, vote] = merged.get((kind, vote), 0) + n
    post = em(merged)
    if not counts:
        return []
    keys = sorted(counts)
    x = np.array([_row(*k) for k in keys])
    y = np.array([post[k[:2]] for k in keys])
    n = np.array([counts[k] for k in keys], float)
    n /= n.max()
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (n * (p - y)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def _size(start: int, end: int) -> int:
    return min(7, int(math.log2(max(1, end - start))))


_FOUND = "doc_id long, spans array<struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,size:int>>"


def _find(batches):
    for batch in batches:
        out = []
        for value in batch.column(1):
            text = value.as_py()
            base = base_spans(text)
            spans = [(*s, True) for s in base] + [(*s, False) for s in proposals(text, base)]
            out.append([{"start": a, "kind": k, "end": b, "base": own, "votes": votes(text, a, k, b, own), "size": _size(a, b)} for a, k, b, own in sorted(spans)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.list_(pa.int32())), ("size", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])


def _joined(spans: list[dict]) -> str:
    return ",".join(f"{KINDS[s['kind']]}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (s["start"], s["kind"])))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base rules; spans lists those and what the classifier adds, as
    kind:start:end in code points. Addresses and secrets may have any length. Null counts as empty; an empty text
    has no spans. Rows with null or repeated ids get a row each. Other columns are ignored; an empty table gives an
    empty result.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(F.col(text_col)).alias("text"))
    found = written(rows.mapInArrow(_find, _FOUND), "spans")
    each = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.size").count()
    counts = {(r["kind"], tuple(r["votes"]), r["size"]): r["count"] for r in each.collect()}  # at most kinds * 3^labelers * 8
    weights = np.array(classifier(counts))

    def decide(batches):
        sure: dict[tuple, bool] = {}
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for spans in batch.column(1).to_pylist():
                base = [s for s in spans if s["base"]]
                for k in range(4):
                    columns[k].append(sum(s["kind"] == k for s in base))
                columns[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                for s in spans:
                    key = (s["kind"], tuple(s["votes"]), s["size"])
                    if key not in sure:
                        sure[key] = float(np.array(_row(*key)) @ weights) >= 0
                columns[5].append(_joined([s for s in spans if s["base"] or sure[s["kind"], tuple(s["votes"]), s["size"]]]))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
