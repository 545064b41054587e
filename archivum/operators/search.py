"""Search: an operator grammar and a typed condition model, compiled to DataFrame predicates.

``parse`` reads a search line into a ``Query``; ``text_condition`` compiles its free text, with the Boolean rules of
full-text search.  ``Spec`` groups hold conditions; ``confirm`` splits rows into those that match for certain and those
that can't be judged because their text has not been read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grammar's keys, and what the words after ``sort:``, ``is:`` and ``recovery:`` mean.
KEYS = {"from": "sender", "to": "recipient", "subject": "subject", "domain": "domain", "tag": "tag", "label": "tag", "source": "source", "evidence": "evidence", "type": "type", "filename": "filename", "attachment": "filename"}
SORTS = {"newest": "newest", "date": "newest", "datedesc": "newest", "oldest": "oldest", "dateasc": "oldest", "subject": "subject", "az": "subject", "size": "size", "largest": "size", "priority": "priority"}
RECOVERY = {
    "deleted": "deletedFolder", "deletedfolder": "deletedFolder", "trash": "deletedFolder", "flagged": "flaggedDeleted", "flaggeddeleted": "flaggedDeleted", "unpurged": "unpurged", "expunged": "unpurged",
    "orphan": "orphan", "orphans": "orphan", "carved": "carved", "stub": "deletionStub", "stubs": "deletionStub", "deletionstub": "deletionStub", "any": "any", "all": "any",
}
_ORDERS = {"newest": ["-ts", "id"], "oldest": ["ts", "id"], "subject": ["subject", "id"], "size": ["-size", "id"], "priority": ["-priority", "id"]}


@dataclass
class Query:
    """Conditions that all hold, excluded ones of which none does, free text, and the order asked for."""

    fields: dict[str, str] = field(default_factory=dict)
    excluded: list[tuple[str, str]] = field(default_factory=list)
    text: str | None = None
    order: str | None = None
    with_trash: bool = False


def read_date(text: str) -> date | None:
    """yyyy-MM-dd, yyyy/MM/dd or MM/dd/yyyy; None for anything else."""
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y"):
        try:
            return datetime.strptime(text, form).date()
        except ValueError:
            continue
    return None


def _known(key: str, value: str) -> tuple[str, str] | None:
    """(field, value) of ``key:value``, None where the value can't be read: such a word is searched as text."""
    small = value.lower()
    if key in KEYS:
        return (KEYS[key], value) if value or KEYS[key] not in ("filename",) else None
    if key in ("has", "no") and small in ("attachment", "attachments"):
        return "attachments", "yes" if key == "has" else "no"
    if key in ("before", "after") and read_date(value):
        return key, value
    if key == "is" and small in ("pinned", "starred"):
        return "pinned", ""
    if key == "is" and small in ("recovered", "deleted"):
        return "recovery", "any"
    if key == "recovery" and small in RECOVERY:
        return "recovery", RECOVERY[small]
    return None


def parse(line: str) -> Query:
    """A search line: ``key:value`` conditions, of which the last of a key wins, and free text.

    ``-key:value`` and ``NOT key:value`` exclude.  What can't be read as a condition stays text, so every line is valid;
    white space inside double quotes doesn't end a word.
    """
    out, free, negate = Query(), [], False
    for token in re.findall(r'(?:[^\s"]|"[^"]*(?:"|$))+', line):
        if token == "NOT":
            negate = True
            continue
        minus = token.startswith("-") and ":" in token
        key, colon, value = token[minus:].partition(":")
        excluding, negate = negate or minus, False
        value = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
        found = _known(key.lower(), value) if colon and key else None
        if excluding:
            if found and found != ("attachments", "no") and (value or found[0] not in ("source", "evidence", "type")):
                out.excluded.append(found)
            else:
                free.extend([token] if colon else ["NOT", token])
        elif found:
            out.fields[found[0]] = found[1]
            if found[0] == "filename":
                out.fields["attachments"] = "yes"
        elif colon and key.lower() == "sort" and value.lower() in SORTS:
            out.order = SORTS[value.lower()]
        elif colon and key.lower() == "in" and value.lower() == "trash":
            out.with_trash = True
        else:
            free.append(token)
    out.text = " ".join(free).strip() or None
    return out


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def field_condition(name: str, value: str) -> Column:
    """A field's condition over the message columns; a missing value matches nothing."""
    small = value.lower()
    if name in ("sender", "subject", "recipient"):
        return _some(F.lower(name).contains(small))
    if name == "domain":
        return _some(F.array_contains("domains", small))
    if name in ("tag", "evidence"):
        return _some(F.array_contains("tags" if name == "tag" else "evidence", value))
    if name == "source":
        return _some(F.col("source") == value)
    if name == "type":
        return _some(F.lower("message_type") == small)
    if name == "filename":
        return _some(F.exists("attachments", lambda a: F.lower(a).contains(small)))
    if name == "attachments":
        some = _some(F.size("attachments") > 0)
        return ~some if value == "no" else some
    if name == "pinned":
        return _some(F.col("pinned"))
    if name == "recovery":
        return _some(F.col("recovery").isNotNull() if value == "any" else F.col("recovery") == value)
    if name in ("before", "after"):
        bound = F.lit(datetime.combine(read_date(value), datetime.min.time())).cast("timestamp_ntz")
        return _some(F.col("ts") < bound if name == "before" else F.col("ts") >= bound)
    raise ValueError(name)


def on_or_after(ts: Column, day: date, zone: str = "UTC") -> Column:
    """Whether an instant (UTC, without zone) lies on that calendar day of ``zone`` or later."""
    return _some(F.from_utc_timestamp(ts, zone) >= F.lit(datetime.combine(day, datetime.min.time())))


def on_or_before(ts: Column, day: date, zone: str = "UTC") -> Column:
    """Whether an instant (UTC, without zone) lies on that calendar day of ``zone`` or earlier."""
    return _some(F.from_utc_timestamp(ts, zone) < F.lit(datetime.combine(day + timedelta(days=1), datetime.min.time())))


def word_match(text: Column, word: str, prefix: bool = True) -> Column:
    """Whether a word or a phrase occurs from a word's start; without ``prefix``, up to a word's end; case is ignored."""
    body = r"[^\p{L}\p{N}]+".join(re.escape(w) for w in re.findall(r"[^\W_]+", word)) or re.escape(word)
    return _some(text.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}]){body}" + ("" if prefix else r"($|[^\p{L}\p{N}])")))


def text_condition(text: Column, line: str) -> Column:
    """Free text: all words, the last one also as a beginning; AND, OR, NOT in capitals between words are operators.

    Words side by side bind first, then NOT, AND, OR.  ``AND NOT`` is NOT; an operator with nothing on a side is a word.
    ``-word`` excludes the word from the whole answer if there is another word to search for.
    """
    tokens = line.split()
    exclusion = re.compile(r"-.*[^\W_]")
    if all(t in ("AND", "OR", "NOT") or exclusion.match(t) for t in tokens):
        exclusion = re.compile("$^")  # nothing else to search for: words
    excluded = [t[1:] for t in tokens if exclusion.match(t)]
    pieces: list[tuple[bool, str]] = []  # (is an operator, what)
    for t in (t for t in tokens if not exclusion.match(t)):
        operator = t in ("AND", "OR", "NOT") and bool(pieces)
        if operator and pieces[-1] == (True, "AND") and t == "NOT":
            pieces[-1] = (True, "NOT")
        else:
            pieces.append((operator and not pieces[-1][0], t))
    if pieces and pieces[-1][0]:
        pieces[-1] = (False, pieces[-1][1])
    last = max((i for i, (op, _) in enumerate(pieces) if not op), default=-1)
    # runs of words, with the operator in front of each
    runs: list[tuple[str | None, Column]] = []
    operator = None
    for i, (is_operator, t) in enumerate(pieces):
        if is_operator:
            operator = t
            continue
        one = word_match(text, t, prefix=i == last)
        if runs and operator is None:
            runs[-1] = (runs[-1][0], runs[-1][1] & one)
        else:
            runs.append((operator, one))
        operator = None
    either: list[Column] = []
    for operator, c in runs:  # NOT joins its left neighbour alone, so it needs no parentheses before AND
        if operator in (None, "OR"):
            either.append(c)
        else:
            either[-1] = either[-1] & (~c if operator == "NOT" else c)
    out = reduce(Column.__or__, either, F.lit(False)) if either else F.lit(True)
    return reduce(lambda a, w: a & ~word_match(text, w, prefix=False), excluded, out)


def predicate(q: Query, text: str = "body") -> Column:
    """The condition of a query: fields and text hold, nothing that is excluded does."""
    conditions = [field_condition(n, v) for n, v in q.fields.items()] + [~field_condition(n, v) for n, v in q.excluded]
    if q.text:
        conditions.append(text_condition(F.col(text), q.text))
    return reduce(Column.__and__, conditions, F.lit(True))


def search(df: DataFrame, line: str, text: str = "body") -> DataFrame:
    """Rows that a search line finds, in the order it asks for; rows in the trash (column ``trashed``) only if it says so."""
    q = parse(line)
    out = df.where(predicate(q, text))
    if "trashed" in df.columns and not q.with_trash:
        out = out.where(~_some(F.col("trashed")))
    if q.order:
        out = out.orderBy(*(F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in _ORDERS[q.order]))
    return out


@dataclass(frozen=True)
class Condition:
    """One condition; ``reads_text`` says that it can't be judged where the text has not been read."""

    holds: Column
    reads_text: bool = False
    negated: bool = False


@dataclass(frozen=True)
class Group:
    """``kind`` all: every condition; any: one of the branches, each a list of conditions; exclude: none of the branches."""

    kind: str
    branches: list[list[Condition]]


def _branch(conditions: list[Condition]) -> Column:
    each = [~F.coalesce(c.holds, F.lit(False)) if c.negated else F.coalesce(c.holds, F.lit(False)) for c in conditions]
    return reduce(Column.__and__, each, F.lit(True))


def spec_condition(groups: list[Group]) -> Column:
    """All groups that aren't empty hold."""
    out = F.lit(True)
    for g in groups:
        branches = [_branch(b) for b in g.branches if b]
        if branches:
            one = reduce(Column.__or__, branches) if g.kind != "all" else reduce(Column.__and__, branches)
            out = out & (~one if g.kind == "exclude" else one)
    return out


def needs_text(groups: list[Group]) -> bool:
    """Whether missing text could change the answer: an exclusion, a negation or one of several branches reads it."""
    for g in groups:
        branches = [b for b in g.branches if b]
        for b in branches:
            if any(c.reads_text and (g.kind == "exclude" or c.negated or (g.kind == "any" and len(branches) > 1)) for c in b):
                return True
    return False


def confirm(df: DataFrame, groups: list[Group], evaluable: Column) -> tuple[DataFrame, DataFrame]:
    """(confirmed, unresolved): rows that match, and rows that match as far as can be told but whose text isn't read.

    Missing text is no evidence: a row is unresolved, never excluded, where only its text could settle the answer.
    """
    matches = spec_condition(groups)
    if not needs_text(groups):
        return df.where(matches), df.where(F.lit(False))
    ready = F.coalesce(evaluable, F.lit(False))
    return df.where(matches & ready), df.where(~ready)
