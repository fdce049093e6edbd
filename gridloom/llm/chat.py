"""Chat formatting: records of many layouts to canonical turns, to one marked text with a loss mask, and back.

A record's schema is the set of its nested field paths (arrays as ``[]``); the hash of the sorted paths selects a
declarative mapping. The template marks turns by control strings; the same strings inside a text are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True, eq=False)
class Mapping:
    """How a layout becomes turns.

    ``turns``: path of the list of messages with the names of role and text; or ``fields``: (path, role) pairs in order,
    of which null or missing ones are skipped if optional (a path ending in ``?``). ``roles`` renames roles.
    """

    name: str
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def layouts(self) -> list[frozenset[str]]:
        """The path sets that this mapping takes, apart from paths of extra fields."""
        if self.turns:
            at, role, text = self.turns
            return [frozenset({f"{at}[].{role}", f"{at}[].{text}"})]
        need = [p for p, _ in self.fields if not p.endswith("?")]
        maybe = [p[:-1] for p, _ in self.fields if p.endswith("?")]
        sets = [frozenset(need)]
        for p in maybe:
            sets += [s | {p} for s in sets]
        return sets


MAPPINGS = (
    Mapping("messages", turns=("messages", "role", "content")),
    Mapping("messages_text", turns=("messages", "role", "text")),
    Mapping("conversations", turns=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant", "bot": "assistant"}),
    Mapping("instruction", fields=(("system?", "system"), ("instruction", "user"), ("input?", "user"), ("output", "assistant"))),
    Mapping("prompt_response", fields=(("system?", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt_completion", fields=(("system?", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Mapping("question_answer", fields=(("context?", "system"), ("question", "user"), ("answer", "assistant"))),
)
#: Top-level fields that say nothing about turns.
IGNORED = frozenset({"id", "conv_id", "source", "lang"})


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; an empty list counts as its own path."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_fingerprint(found: Iterable[str]) -> str:
    return f"{xxhash.xxh64_intdigest(chr(10).join(sorted(set(found))), 0):016x}"


def registry(mappings: Iterable[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Mapping by schema fingerprint; a list that is empty has a layout of its own, without turns."""
    out = {}
    for m in mappings:
        for layout in m.layouts():
            out.setdefault(schema_fingerprint(layout), m)
        if m.turns:
            out.setdefault(schema_fingerprint({f"{m.turns[0]}[]"}), m)
    return out


def known_paths(mappings: Iterable[Mapping] = MAPPINGS) -> frozenset[str]:
    return frozenset(p for m in mappings for layout in m.layouts() for p in layout)


def reduced(found: Iterable[str], known: frozenset[str]) -> set[str]:
    """The paths of mappings that occur; what lies inside such a field counts as the field, other fields do not count."""
    out = set()
    for path in found:
        cut = [k for k in known if path == k or path.startswith((f"{k}.", f"{k}["))]
        out |= {max(cut, key=len)} if cut else set()
    return out


def as_text(value) -> str:
    """A role or text of any JSON value: null is empty, a list of parts is its texts joined, other values are their JSON.

    Lone surrogates, which no UTF-8 text can hold, become U+FFFD.
    """
    if value is None:
        return ""
    if isinstance(value, list) and value and all(isinstance(x, str) or (isinstance(x, dict) and isinstance(x.get("text"), str)) for x in value):
        value = "".join(x if isinstance(x, str) else x["text"] for x in value)
    if not isinstance(value, str):
        value = json.dumps(value, ensure_ascii=False, sort_keys=True)
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical_turns(record: dict, by_fingerprint: dict[str, Mapping], known: frozenset[str] | None = None) -> tuple[str, str | None, list[tuple[str, str]]]:
    """(fingerprint, mapping or None, turns) of a record. Null roles and texts are empty.

    The fingerprint of all paths selects the mapping. If none has it, that of the paths that mappings name does, so that
    further fields and parts inside a field change nothing; last, the first mapping whose fields are all there.
    """
    found = {p for p in paths(record) if p.split(".")[0] not in IGNORED}
    print_ = schema_fingerprint(found)
    m = by_fingerprint.get(print_)
    if m is None:
        mine = reduced(found, known if known is not None else known_paths(by_fingerprint.values()))
        m = by_fingerprint.get(schema_fingerprint(mine)) if mine else None
        if m is None:
            m = next((x for x in dict.fromkeys(by_fingerprint.values()) if any(layout <= mine for layout in x.layouts())), None)
    if m is None:
        return print_, None, []
    if m.turns:
        at, role, text = m.turns
        items = record[at] if isinstance(record[at], list) else []
        turns = [(as_text(t.get(role)), as_text(t.get(text))) if isinstance(t, dict) else ("", as_text(t)) for t in items]
        return print_, m.name, [(m.roles.get(r, r), t) for r, t in turns]
    return print_, m.name, [(role, as_text(record[p])) for path, role in m.fields if (p := path.rstrip("?")) in record]


def escape(text: str) -> str:
    """``text`` without ``<|``: one backslash more goes into each ``<``, backslashes, ``|``."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text) if "|" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def format_turns(turns: Iterable[tuple[str, str]], learn: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[tuple[int, int]]]:
    """The marked text and the loss mask: code-point spans of the (escaped) texts of the roles to learn."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head)
        if role in learn:
            spans.append((at, at + len(body)))
        out += [head, body, END, "\n"]
        at += len(body) + len(END) + 1
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, exactly as they went in."""
    turns = []
    for part in formatted.split(f"{END}\n")[:-1]:
        role, _, text = part.removeprefix(START).partition("\n")
        turns.append((unescape_role(role), unescape(text)))
    return turns


RESULT = "conv_id long, schema_hash string, mapping string, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_records(records: DataFrame, id_col: str = "conv_id", json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """JSON records of any layout to formatted texts, a row for each record.

    Unknown layouts, null and unparsable records, those that are no object and those nested too deeply have a null
    mapping, no turns and an empty text; nothing is dropped. Roles and texts that are no strings are as ``as_text`` says.
    Texts of any length are formatted whole. Repeated rows give repeated rows, turns keep the record's order. Other
    columns are ignored. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, named = registry(mappings), known_paths(mappings)
        for b in batches:
            rows = []
            for conv, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                print_, name, turns = schema_fingerprint([]), None, []
                try:
                    record = json.loads(raw or "")
                    if isinstance(record, dict):
                        print_, name, turns = canonical_turns(record, known, named)
                except (ValueError, RecursionError):
                    pass
                text, spans = format_turns(turns)
                rows.append({"conv_id": conv, "schema_hash": print_, "mapping": name, "n_turns": len(turns), "formatted": text, "loss_spans": [{"start": s, "end": e} for s, e in spans]})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return records.select(F.col(id_col).cast("long").alias("conv_id"), F.col(json_col).alias("record")).mapInArrow(run, RESULT)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.schema([("conv_id", pa.int64()), ("schema_hash", pa.string()), ("mapping", pa.string()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(_SPAN))])


def records_from_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Rows ``(id, turn, role, text)`` to one JSON record of the messages layout for each id, turns in order.

    Equal turn numbers go by role, then text; null turn numbers come first. A null id is one conversation. A record holds
    one conversation whole, so that its turns must fit a row. An empty table gives an empty result; other columns are ignored.
    """
    message = F.struct(F.col("turn").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = turns.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(message)).alias("all"))
    messages = F.transform("all", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(F.col("conv_id"), messages.alias("messages"))).alias("record"))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, schema_hash string, mapping string"


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted texts and loss masks hold, read back from them: a row for each row.

    A text without turns has none of them and the digests of the empty string. Repeated rows stay; an empty table gives an
    empty result; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns = parse_turns(r["formatted"])
                learnt = "".join(unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"])
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (whole, learnt)]
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": sha[0], "loss_chars": len(learnt), "loss_sha256": sha[1], "formatted_chars": len(r["formatted"]), "schema_hash": r["schema_hash"], "mapping": r["mapping"]})
            yield pa.RecordBatch.from_pylist(rows, schema=_DIGEST)

    return formatted.select("conv_id", "formatted", "loss_spans", "schema_hash", "mapping").mapInArrow(run, DIGEST)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("schema_hash", pa.string()), ("mapping", pa.string())])
