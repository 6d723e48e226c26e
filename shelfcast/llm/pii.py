"""Personal data by patterns and a skip-chain conditional random field (operator 3).

Base spans (e-mail, IP, card, phone) come from fixed patterns and always stay.
The field adds spans that the patterns miss: loosely written numbers and
addresses of a document are further nodes beside the base spans. Neighbouring
nodes are linked in a chain; distant nodes that repeat the same or similar
digits or address share skip potentials. Base nodes are observed; loopy
sum-product message passing carries their labels along the links, and a loose
node becomes a span where its marginal for a label reaches ``certain``. A label
that no base span among a node's repetitions has is doubted: ``UNSEEN`` nats
and the strongest skip weight count against it, so that repeated lookalikes
alone don't talk each other into one, while a shape that is all but certain
still can.

Unary weights (a logistic model per label on shape and context bits), chain and
skip potentials are learned from the base spans of all documents, so that a rare
kind counts too. Only counts per distinct bit pattern reach the driver. Skip
potentials are rates of agreement, which don't grow with the table.

Defined cases: a null text counts as empty; texts without digits or ``@`` have
no span; kinds may overlap each other and are matched apart; repeated rows are
handled alike, and extra columns are kept or ignored; an empty table gives an
empty table. Whole texts are searched, in time linear in their length; messages
take about 1 KB a mention of one text, and mentions have seven characters at least.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .labelled import Logistic

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Any text with a span has one of these.
HINT = re.compile(r"[0-9@]|[(\[{]at[)\]}]", re.I)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, which keeps the search linear
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Loosely written numbers, apart from letters; and addresses with a spelled-out @.
LOOSE_NUMBER = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[ ().\-/_]{0,3}[0-9])++(?![A-Za-z0-9])")
LOOSE_AT = re.compile(r" ?(?:[(\[{]at[)\]}]|@) ?", re.I)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{]dot[)\]}]|\.) ?[A-Za-z0-9-]{1,63})+", re.I)
LOOSE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
CONTEXT = (
    frozenset("phone tel telephone call mobile cell fax whatsapp telefon anruf handy teléfono móvil llamar téléphone appeler".split()),
    frozenset("email e-mail mail contact write mailto kontakt correo contacto courriel".split()),
    frozenset("card credit visa mastercard amex payment karte kreditkarte tarjeta carte".split()),
    frozenset("ip host server address gateway dns adresse dirección".split()),
)
BITS = 13
#: Share of the prior rate in a rate of agreement; it bounds a skip weight by ln 999.
DOUBT = 0.01
#: Nats against a label that is not observed among a mention's repetitions.
UNSEEN = 8.0
SPANS = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])
TALLY = pa.schema([("part", pa.string()), ("x", pa.int64()), ("y", pa.int64()), ("n", pa.int64())])


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Candidates that touch no base span."""
    busy = sorted((a, b) for _, a, b in taken)
    found = [m.span() for m in LOOSE_NUMBER.finditer(text) if 7 <= len(_digits(m.group())) <= 19]
    for m in LOOSE_AT.finditer(text):
        local = LOOSE_LOCAL.search(text[max(0, m.start() - 64):m.start()])
        domain = LOOSE_DOMAIN.match(text, m.end())
        if local and domain:
            found.append((m.start() - len(local.group()), domain.end()))
    out, i, last = [], 0, 0
    for a, b in sorted(found):
        while i < len(busy) and busy[i][1] <= a:
            i += 1
        if a >= last and not (i < len(busy) and busy[i][0] < b):
            out.append((a, b))
            last = b
    return out


def _keys(mention: str) -> tuple[str, str]:
    """What the same, and what similar mentions share."""
    if "@" in mention or re.search(r"[(\[{]at[)\]}]", mention, re.I):
        plain = re.sub(r"[(\[{]dot[)\]}]", ".", re.sub(r"[(\[{]at[)\]}]", "@", mention, flags=re.I), flags=re.I).replace(" ", "").lower()
        return "@" + plain, "@" + plain.partition("@")[0]
    digits = _digits(mention)
    return digits, digits[-7:]


def _bits(text: str, a: int, b: int) -> int:
    mention = text[a:b]
    digits = len(_digits(mention))
    before = {w.strip(".,:;()<>\"'").lower() for w in text[max(0, a - 48):a].split()[-4:]}
    flags = [mention.count(".") == 3, mention.startswith("+"), "(" in mention, " " in mention or "-" in mention,
             "@" in mention or "at" in mention.lower(), digits < 9, 9 <= digits <= 12, digits >= 13, "/" in mention or "_" in mention,
             *[bool(before & words) for words in CONTEXT]]
    return sum(1 << i for i, f in enumerate(flags) if f)


class Graph:
    """Nodes and links of one document. Node: (start, end, label or -1 if unknown)."""

    def __init__(self, text: str):
        base = base_spans(text)
        nodes = [(a, b, LABELS.index(k)) for k, a, b in base] + [(a, b, -1) for a, b in loose_spans(text, base)]
        self.base = base
        self.nodes = sorted(nodes)
        self.bits = [_bits(text, a, b) for a, b, _ in self.nodes]
        keys = [_keys(text[a:b]) for a, b, _ in self.nodes]
        # chain links of near neighbours; same and similar mentions are linked one to the next
        self.chain = [(i, i + 1) for i in range(len(nodes) - 1) if self.nodes[i + 1][0] - self.nodes[i][1] <= 200]
        self.same, self.similar = [], []
        seen: list[dict[str, int]] = [{}, {}]
        for i, key in enumerate(keys):
            for k, links in ((0, self.same), (1, self.similar)):
                if key[k] in seen[k] and not (k and keys[seen[1][key[1]]][0] == key[0]):
                    links.append((seen[k][key[k]], i))
                seen[k][key[k]] = i

    def observed_labels(self) -> list[set[int]]:
        """Per node: labels of the base nodes that skip links lead to."""
        root = list(range(len(self.nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        for a, b in self.same + self.similar:
            root[find(b)] = find(a)
        labels: dict[int, set[int]] = {}
        for i, (_, _, label) in enumerate(self.nodes):
            if label >= 0:
                labels.setdefault(find(i), set()).add(label)
        return [labels.get(find(i), set()) for i in range(len(self.nodes))]


class Field:
    """Potentials of the field, from the tallies of the documents."""

    def __init__(self, tallies: dict[tuple[str, int, int], int]):
        n = len(LABELS)
        unary = [(x, y, c) for (part, x, y), c in tallies.items() if part == "unary"]
        self.models = []
        x = np.array([[u[0] >> i & 1 for i in range(BITS)] for u in unary], float).reshape(-1, BITS)
        weight = np.array([float(u[2]) for u in unary])
        for label in range(n):
            y = np.array([float(u[1] == label) for u in unary])
            self.models.append(Logistic(x, y, weight, ridge=1.0) if 0 < y.sum() < len(y) else (0.01 if not y.sum() else 0.99))
        chain = np.ones((n, n))
        for (part, a, b), c in tallies.items():
            if part == "chain":
                chain[a, b] += c
        expected = chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True) / chain.sum()
        self.chain = np.log(chain / expected)
        self.skip = {}
        for kind, prior in (("same", 9.0), ("similar", 9.0)):
            agree, other = tallies.get((kind, 1, 0), 0), tallies.get((kind, 0, 0), 0)
            # the rate of agreement, drawn to the prior rate by few pairs, and by DOUBT however many there are
            rate = (1 - DOUBT) * (agree + prior) / (agree + other + prior + 1.0) + DOUBT * prior / (prior + 1.0)
            self.skip[kind] = np.log(rate / (1 - rate)) * np.eye(n)
        self.unseen = UNSEEN + max(0.0, *(float(t.max()) for t in self.skip.values()))

    def unary(self, bits: list[int]) -> np.ndarray:
        x = np.array([[b >> i & 1 for i in range(BITS)] for b in bits], float)
        p = np.stack([np.full(len(bits), m) if isinstance(m, float) else m(x) for m in self.models], 1)
        return np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))

    def marginals(self, graph: Graph, rounds: int = 30) -> np.ndarray:
        """Loopy sum-product over all links, damped, until messages settle or for ``rounds`` rounds.

        Messages that haven't settled by then count as they are: the marginals
        are those of the last round, the same on every run.
        """
        own, known = self.unary(graph.bits), graph.observed_labels()
        for i, (_, _, label) in enumerate(graph.nodes):
            if label >= 0:
                own[i] = np.where(np.arange(len(LABELS)) == label, 0.0, -50.0)
            else:
                # the doubt against a label that no repetition of the mention is known to have
                own[i] -= np.array([self.unseen if y and y not in known[i] else 0.0 for y in range(len(LABELS))])
        tables = [(self.chain, graph.chain), (self.skip["same"], graph.same), (self.skip["similar"], graph.similar)]
        n = sum(len(links) for _, links in tables)
        if n:
            # message 2 i runs along link i, message 2 i + 1 against it; the links of a kind share a table
            pairs = np.concatenate([np.array(links, np.int64).reshape(-1, 2) for _, links in tables])
            source, target = pairs.reshape(-1), pairs[:, ::-1].reshape(-1)
            back = np.arange(2 * n) ^ 1
            message, at, parts = np.zeros((2 * n, len(LABELS))), 0, []
            for table, links in tables:
                parts += [(slice(2 * at + k, 2 * (at + len(links)) + k, 2), t) for k, t in ((0, table), (1, table.T)) if links]
                at += len(links)
            for _ in range(rounds):
                total = own.copy()
                np.add.at(total, target, message)
                into = total[source] - message[back]
                moved = 0.0
                for part, table in parts:
                    # label by label of the receiver, so that no table is copied for each link
                    here = into[part]
                    new = np.stack([np.logaddexp.reduce(here + table[:, y], axis=1) for y in range(len(LABELS))], 1)
                    new = 0.5 * message[part] + 0.5 * (new - np.logaddexp.reduce(new, axis=1, keepdims=True))
                    moved = max(moved, float(np.abs(new - message[part]).max()))
                    message[part] = new
                if moved < 1e-5:
                    break
            np.add.at(own, target, message)
        own -= np.logaddexp.reduce(own, axis=1, keepdims=True)
        return np.exp(own)


def find_spans(text: str, field: Field | None, certain: float) -> tuple[list, list]:
    """(base spans, all spans), both by kind as listed, then start."""
    if not HINT.search(text):
        return [], []
    graph = Graph(text)
    added = []
    if field is not None and any(label < 0 for _, _, label in graph.nodes):
        for (a, b, label), p in zip(graph.nodes, field.marginals(graph)):
            best = int(p.argmax())
            if label < 0 and best and p[best] >= certain:
                added.append((LABELS[best], a, b))
    return graph.base, sorted(graph.base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def learn_field(docs: DataFrame, sample_docs: int | None = None) -> Field | None:
    """The field of all documents, or None if they have no candidate at all.

    Only a caller that sets ``sample_docs`` gets the field of that many, chosen by a hash of doc_id.
    """
    if sample_docs is not None:
        chosen = (docs.select(F.col("doc_id").alias("doc_id")).where(F.col("doc_id").isNotNull())
                  .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs))
        docs = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id")

    def rows(source):
        counts: Counter = Counter()
        for (text,) in source:
            if not text or not HINT.search(text):
                continue
            graph = Graph(text)
            linked = {i for links in (graph.same, graph.similar) for pair in links for i in pair}
            label = [l for _, _, l in graph.nodes]
            for i, bits in enumerate(graph.bits):
                # a loose node that repeats another is left open; one alone is no entity
                if label[i] >= 0 or i not in linked:
                    counts["unary", bits, max(label[i], 0)] += 1
            for a, b in graph.chain:
                counts["chain", max(label[a], 0), max(label[b], 0)] += 1
            for kind in ("same", "similar"):
                for a, b in getattr(graph, kind):
                    if label[a] >= 0 and label[b] >= 0:
                        counts[kind, int(label[a] == label[b]), 0] += 1
        yield from ((*key, n) for key, n in counts.items())
    # at most 2**BITS * labels bit patterns
    found = map_rows(docs.select("text"), rows, TALLY).groupBy("part", "x", "y").agg(F.sum("n").alias("n")).collect()
    tallies = {(r["part"], r["x"], r["y"]): r["n"] for r in found}
    return Field(tallies) if any(k[0] == "unary" for k in tallies) else None


def _shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame, sample_docs: int | None = None, certain: float = 0.9) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text; counts are of base spans."""
    field = learn_field(docs, sample_docs)

    def rows(source):
        for doc_id, text in source:
            base, spans = find_spans(text or "", field, certain)
            counts = Counter(k for k, _, _ in base)
            yield (doc_id, *[counts[k] for k in KINDS], hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(spans))
    return map_rows(docs.select("doc_id", "text"), rows, SPANS)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind."""
    out, done, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[done:a], f"[{kind.upper()}]"]
        last = done = max(last, b)
    return "".join([*out, text[done:]])


def mask_pii(docs: DataFrame, sample_docs: int | None = None, certain: float = 0.9) -> DataFrame:
    """The documents with personal data masked in ``text`` and ``n_chars`` counted anew; a null text stays null."""
    field = learn_field(docs, sample_docs)

    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else masked(t, find_spans(t, field, certain)[1]))
    text: Column = F.pandas_udf(mask, "string")("text")
    out = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
