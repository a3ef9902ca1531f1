"""Template-constrained decoding as an incremental machine.

A program is the token sequence of a rendered template, its slot markers standing for open
places. The machine holds only where it stands: it consumes one token at a time, so a step
costs the same however long the prefix is; replaying a prefix is a fold over its tokens. The
count slot comes first and selects the program to go on with. After the end one EOS may
follow, and is idempotent.

Categorical slots of few values follow a trie of their token sequences; the others follow
the grammar of `functions.slots` over the decoded text.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordgauge.functions import fields as fd
from recordgauge.functions.slots import MARK, slot_kind, template_text, word_status


class Tokenizer(Protocol):
    """What the machine asks of a tokenizer."""

    eos: int

    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...

    def vocabulary(self) -> list[int]: ...


@dataclass(frozen=True)
class CharacterTokenizer:
    """One token a character (10 + code point), for tests and audits; invisible tokens decode to nothing."""

    eos: int = 2
    alphabet: str = "".join(map(chr, range(32, 127))) + "\n"
    invisible: tuple[int, ...] = (3,)

    def encode(self, text: str) -> list[int]:
        return [10 + ord(c) for c in text]

    def decode(self, ids: list[int]) -> str:
        return "".join(chr(i - 10) for i in ids if i >= 10)

    def vocabulary(self) -> list[int]:
        return [*self.invisible, *self.encode(self.alphabet)]


@dataclass
class MarkedTokenizer:
    """C4: a tokenizer with the slot markers registered as single special tokens, ids above the base vocabulary."""

    base: Tokenizer
    markers: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        first = max([*self.base.vocabulary(), self.base.eos]) + 1
        for k, m in enumerate(fd.KEY_OF_MARKER):
            self.markers.setdefault(f"<|{m}|>", first + k)

    @property
    def eos(self) -> int:
        return self.base.eos

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(MARK.split(text)):
            if k:
                out.append(self.markers[MARK.findall(text)[k - 1]])
            out += self.base.encode(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        names = {i: m for m, i in self.markers.items()}
        return "".join(names[i] if i in names else self.base.decode([i]) for i in ids)

    def vocabulary(self) -> list[int]:
        return [*self.base.vocabulary(), *self.markers.values()]

    def audit(self) -> dict[str, bool]:
        """Whether every marker is one token of its own, no other text makes it, and it reads back."""
        single = all(self.encode(m) == [i] and self.decode([i]) == m for m, i in self.markers.items())
        ids = list(self.markers.values())
        return {"unique": len(set(ids)) == len(ids) == len(fd.KEY_OF_MARKER) and not set(ids) & set(self.base.vocabulary()), "single": single}


class TemplateError(ValueError):
    """A token that the template does not allow."""


@dataclass(frozen=True)
class Literal:
    tokens: tuple[int, ...]


@dataclass(frozen=True)
class Slot:
    marker: str
    label: str
    ends: int  # the first token of the next literal


@dataclass(frozen=True)
class Action:
    kind: str  # fixed, candidate or complete
    token: int | None = None
    allowed: tuple[int, ...] = ()
    slot: str | None = None


@dataclass(frozen=True)
class State:
    count: int | None = None
    node: int = 0
    at: int = 0
    word: tuple[int, ...] = ()
    chosen: tuple[tuple[str, str], ...] = ()
    ended: bool = False


@dataclass
class Runtime:
    """Programs by count, compiled once and kept; capped at MAX_FINDINGS."""

    tokenizer: Tokenizer
    tags: bool = False
    legacy: bool = False
    indent: int | None = None
    programs: dict[int, list[Literal | Slot]] = field(default_factory=dict)
    tries: dict[str, dict[tuple[int, ...], set[int]]] = field(default_factory=dict)

    def program(self, n: int) -> list[Literal | Slot]:
        if not 0 <= n <= fd.MAX_FINDINGS:
            raise TemplateError(f"count {n} is over the cap of {fd.MAX_FINDINGS}")
        if n not in self.programs:
            text = template_text(n, self.tags, self.indent, self.legacy)
            pieces, marks, nodes, seen = MARK.split(text), MARK.findall(text), [], {}
            for k, piece in enumerate(pieces):
                nodes.append(Literal(tuple(self.tokenizer.encode(piece))))
                if k < len(marks):
                    m = marks[k][2:-2]
                    i = seen[m] = seen.get(m, -1) + 1
                    inner = fd.KEY_OF_MARKER[m] in fd.FINDING_FIELDS
                    nodes.append(Slot(m, f"Nodule[{i}].{fd.KEY_OF_MARKER[m]}" if inner else fd.KEY_OF_MARKER[m], self.tokenizer.encode(pieces[k + 1])[0]))
            self.programs[n] = nodes
        return self.programs[n]

    def trie(self, marker: str) -> dict[tuple[int, ...], set[int]]:
        """Prefixes of the candidates and what may follow; -1 where a candidate is complete."""
        if marker not in self.tries:
            out: dict[tuple[int, ...], set[int]] = {}
            for word in (*fd.CATEGORIES[marker], "null"):
                ids = tuple(self.tokenizer.encode(word))
                for k, t in enumerate((*ids, -1)):
                    out.setdefault(ids[:k], set()).add(t)
            self.tries[marker] = out
        return self.tries[marker]

    def allowed(self, slot: Slot, word: tuple[int, ...]) -> list[int]:
        """Tokens that may follow `word` in a slot, ascending."""
        if slot_kind(slot.marker) == "category":
            return sorted(slot.ends if t < 0 else t for t in self.trie(slot.marker).get(word, ()))
        text, out = self.tokenizer.decode(list(word)), []
        for t in self.tokenizer.vocabulary():
            grown = self.tokenizer.decode([*word, t])
            longer = grown.strip() != text.strip() and word_status(slot.marker, grown.strip())[0]
            if t != slot.ends and (longer or not grown and not word):
                out.append(t)
        if word_status(slot.marker, text.strip())[1]:
            out.append(slot.ends)
        return sorted(set(out))

    def action(self, s: State) -> Action:
        """What may come next."""
        nodes = self.program(s.count or 0)
        if s.node >= len(nodes):
            return Action("complete", self.tokenizer.eos, (self.tokenizer.eos,))
        node = nodes[s.node]
        if isinstance(node, Literal):
            return Action("fixed", node.tokens[s.at], (node.tokens[s.at],))
        may = tuple(self.allowed(node, s.word))
        return Action("fixed", may[0], may, node.label) if may == (node.ends,) else Action("candidate", None, may, node.label)

    def step(self, s: State, token: int) -> State:
        nodes = self.program(s.count or 0)
        if s.node >= len(nodes):
            if token == self.tokenizer.eos and not s.ended:
                return replace(s, ended=True)
            raise TemplateError(f"token {token} after the end")
        node = nodes[s.node]
        if token not in (allowed := self.action(s).allowed):
            raise TemplateError(f"token {token} is none of {allowed[:8]}")
        if isinstance(node, Literal):
            return self.settled(replace(s, at=s.at + 1))
        if token != node.ends or token not in self.allowed(node, s.word):
            return replace(s, word=(*s.word, token))
        value = self.tokenizer.decode(list(s.word)).strip()
        count = int(value) if node.marker == "num_nodule" else s.count
        done = replace(s, count=count, node=s.node + 1, at=1, word=(), chosen=(*s.chosen, (node.label, value)))
        return self.settled(done)

    def settled(self, s: State) -> State:
        """Past the end of a literal."""
        nodes = self.program(s.count or 0)
        while s.node < len(nodes) and isinstance(nodes[s.node], Literal) and s.at >= len(nodes[s.node].tokens):
            s = replace(s, node=s.node + 1, at=0)
        return s

    def replay(self, tokens: list[int]) -> State:
        """C9."""
        s = self.settled(State())
        for t in tokens:
            s = self.step(s, t)
        return s

    def render(self, n: int, selections: dict[str, str] | None = None) -> list[int]:
        """One legal path; slots that aren't selected are 'null'."""
        out: list[int] = []
        chosen = {"Number of Nodules": str(n), **(selections or {})}
        for node in self.program(n):
            out += node.tokens if isinstance(node, Literal) else self.tokenizer.encode(chosen.get(node.label, "null"))
        return out

    def trace(self, tokens: list[int]) -> list[dict[str, Any]]:
        """The slots passed, in order, with the expansion that the count chose."""
        s = self.replay(tokens)
        return [{"pos": k, "slot": label, "value": value, "expanded_to": int(value) if label == "Number of Nodules" else None} for k, (label, value) in enumerate(s.chosen)]

    def audit(self) -> dict[str, Any]:
        """Marker counts of the programs of 0, 1 and 2, and whether each replays to its end."""
        out: dict[str, Any] = {}
        for n in (0, 1, 2):
            slots = [x for x in self.program(n) if isinstance(x, Slot)]
            out[f"slots_{n}"] = len(slots)
            out[f"replays_{n}"] = self.action(self.replay(self.render(n))).kind == "complete"
        out["vocabulary"] = len(self.tokenizer.vocabulary())
        return out


_RUNTIMES: dict[Any, Runtime] = {}


def cached_runtime(tokenizer: Tokenizer, tags: bool = False, legacy: bool = False) -> Runtime:
    """C14: one runtime a process for each configuration."""
    return _RUNTIMES.setdefault((repr(tokenizer), tags, legacy), Runtime(tokenizer, tags, legacy))


@dataclass(frozen=True)
class Sampling:
    """Checked parameters of the logit transforms."""

    temperature: float = 1.0
    top_k: int = 0
    top_p: float = 1.0
    min_p: float = 0.0
    repetition: float = 1.0
    frequency: float = 0.0
    presence: float = 0.0

    def __post_init__(self):
        good = self.temperature >= 0 and self.top_k >= 0 and 0 < self.top_p <= 1 and 0 <= self.min_p <= 1 and self.repetition > 0
        if not good:
            raise ValueError("sampling parameter out of range")

    def choose(self, logits: np.ndarray, history: list[int], allowed: list[int]) -> np.ndarray:
        """C11: logits with all but the chosen token at -inf; every transform acts inside the legal set; lowest id on ties."""
        ids = np.array(sorted(set(allowed)))
        x = logits[ids].astype(np.float64)
        seen = np.array([history.count(int(t)) for t in ids])
        was = seen > 0
        x = np.where(was, np.where(x > 0, x / self.repetition, x * self.repetition), x) - self.frequency * seen - self.presence * was
        if self.temperature > 0:
            x = x / self.temperature
        keep = np.ones(len(x), dtype=bool)
        if 0 < self.top_k < len(x):
            keep &= x >= np.sort(x)[-self.top_k]
        order = np.argsort(x, kind="stable")
        p = np.exp(np.where(keep, x, -np.inf)[order] - x.max())
        p /= p.sum()
        tail = np.cumsum(p) <= 1 - self.top_p
        tail[-1] = False
        keep[order[tail]] = False
        keep &= np.exp(x - x[keep].max()) >= self.min_p
        out = np.full(len(logits), -np.inf)
        out[ids[int(np.where(keep, x, -np.inf).argmax())]] = 0.0
        return out


def choose_column(df: DataFrame, logits: str, allowed: str, history: str, sampling: Sampling) -> DataFrame:
    """C11 over columns: `chosen`, the token that the transforms leave of each row's logits; null where nothing is allowed."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("chosen", T.IntegerType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = zip(*[b.column(c).to_pylist() for c in (logits, allowed, history)], strict=True)
            out = [int(np.argmax(sampling.choose(np.array(x, dtype=np.float64), list(seen or []), list(legal)))) if legal else None for x, legal, seen in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=schema.names)

    return df.mapInArrow(run, schema)


def top_p_mask(df: DataFrame, step: str, logit: str, token: str, top_p: float, min_p: float = 0.0) -> DataFrame:
    """W4, W5 relationally: `kept` of each (step, token): ascending running probability over 1 - top_p, and min-p."""
    whole = Window.partitionBy(step)
    weight = F.exp(F.col(logit) - F.max(logit).over(whole))
    d = df.withColumn("__w", weight).withColumn("__p", F.col("__w") / F.sum("__w").over(whole))
    up = whole.orderBy(F.asc(logit), F.desc(token)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = whole.orderBy(F.desc(logit), F.asc(token))
    kept = ((F.sum("__p").over(up) > 1 - top_p) | (F.row_number().over(down) == 1)) & (F.col("__p") >= min_p * F.max("__p").over(whole))
    return d.withColumn("kept", kept).withColumnRenamed("__p", "probability").drop("__w")


def replay_column(df: DataFrame, tokens: str, tokenizer: Tokenizer, tags: bool = False) -> DataFrame:
    """C9 over a column of token arrays: struct-like columns complete, count, slot, action, allowed, error."""
    from pyspark.sql import types as T

    extra = (("complete", T.BooleanType()), ("count", T.IntegerType()), ("action", T.StringType()), ("slot", T.StringType()), ("allowed", T.ArrayType(T.IntegerType())), ("error", T.StringType()))
    schema = T.StructType([*df.schema.fields, *[T.StructField(*e) for e in extra]])

    def run(batches):
        import pyarrow as pa

        runtime = Runtime(tokenizer, tags)
        for b in batches:
            rows = []
            for ids in b.column(tokens).to_pylist():
                try:
                    s = runtime.replay(list(ids or []))
                    a = runtime.action(s)
                    rows.append((a.kind == "complete", s.count, a.kind, a.slot, list(a.allowed), None))
                except TemplateError as e:
                    rows.append((False, None, None, None, None, str(e)))
            kinds = (pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]], names=schema.names)

    return df.mapInArrow(run, schema)
