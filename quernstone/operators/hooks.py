"""Where models plug in: text generation and what is made of its replies, with deterministic stand-ins."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Executor, ThreadPoolExecutor
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Model = Callable[[str], str]


def stub_model(prompt: str) -> str:
    """A stand-in for a language model: the prompt's last line."""
    return prompt.rstrip().rpartition("\n")[2]


def failing_model(prompt: str) -> str:
    """A stand-in that fails where the prompt's last line is FAIL."""
    if stub_model(prompt) == "FAIL":
        raise RuntimeError("no reply")
    return stub_model(prompt)


def parity_judge(prompt: str) -> str:
    """A stand-in for a judge: no where the prompt's first number is divisible by four, else yes."""
    return "no" if int(re.search(r"\d+", prompt)[0]) % 4 == 0 else "yes"


def windowed(texts: Iterable[str], call: Callable[[str], object], window: int, pool: Executor) -> list:
    """``call`` of each text, in their order, with up to ``window`` calls open: each of as many threads takes the next text as its last call ends.

    The pool is given a thread's work at a time, not a call: handing over each call costs many times what a quick one takes.
    """
    texts = list(texts)
    found, left = [None] * len(texts), iter(range(len(texts)))

    def work() -> None:
        for i in left:
            found[i] = call(texts[i])

    for worker in [pool.submit(work) for _ in range(min(window, len(texts)))]:
        worker.result()
    return found


def patient(call: Model, tries: int, pause: float, budget: float) -> Callable[[str], tuple[str | None, str | None]]:
    """(reply, error) of a call that is tried again after ``pause`` seconds, then twice as many, and so on, while the row's ``budget`` of seconds allows."""

    def one(text: str) -> tuple[str | None, str | None]:
        until, error = time.monotonic() + budget, None
        for turn in range(tries):
            try:
                return call(text), None
            except Exception as e:  # noqa: BLE001  what a client raises is not ours to know
                error = f"{type(e).__name__}: {e}"
            wait = pause * 2**turn
            if turn + 1 == tries or time.monotonic() + wait > until:
                break
            time.sleep(wait)
        return None, error

    return one


def generate(rows: DataFrame, prompt: str, model: Callable[[], Model], tries: int = 5, window: int = 8, pause: float = 0.0, budget: float = 600.0) -> DataFrame:
    """``rows`` with ``reply`` and ``error``: a client a partition with up to ``window`` calls open, each tried up to ``tries`` times.

    Replies come in the order of the rows, and a slow one holds back only its own thread until its Arrow batch ends. A call that keeps failing, or
    that has used up its ``budget`` of seconds, leaves a null reply and its last error, not an empty result. A client is called from several
    threads; one that can't be takes ``window=1``. Only prompts become Python objects, the other columns stay in Arrow.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = patient(model(), tries, pause, budget)
        with ThreadPoolExecutor(window) as pool:
            for batch in batches:
                texts = batch.column(prompt)
                found = windowed(texts.to_pylist(), call, window, pool)
                for i, name in enumerate(("reply", "error")):
                    batch = batch.append_column(name, pa.array([f[i] for f in found], texts.type))
                yield batch

    return rows.mapInArrow(run, schema)


def named_entities(text: Column) -> Column:
    """A stand-in for entity recognition: distinct capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b\p{Lu}\p{Ll}+\b"), F.lit(0)))


def render(template: Column, **values: Column) -> Column:
    """A prompt from a template with ``{name}`` places."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"{{{name}}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


_WORDS = {"true": True, "false": False, "null": None, "none": None, "nan": None}
_BARE = re.compile(r"[^\s,:\[\]{}\"']+(?:[ \t]+[^\s,:\[\]{}\"']+)*")
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _tokens(text: str) -> Iterator[tuple[str, object]]:
    """Marks ("[", "]", "{", "}", ",", ":") and values of a damaged JSON text from its first bracket on.

    A string ends at its own quote if what follows it can follow a string: a comma, a colon, a closing bracket, a line's end or the end; so apostrophes and
    stray quotes inside stay. One that never ends goes on to the end. Bare words are constants, numbers or strings.
    """
    at = 0
    while at < len(text):
        c = text[at]
        if c in "[]{},:":
            yield c, None
            at += 1
        elif c in "\"'":
            out, at = [], at + 1
            while at < len(text):
                d = text[at]
                if d == "\\" and at + 1 < len(text):
                    e = text[at + 1]
                    if e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[at + 2 : at + 6]):
                        out.append(chr(int(text[at + 2 : at + 6], 16)))
                        at += 6
                    else:
                        out.append(_ESCAPE.get(e, e))
                        at += 2
                elif d == c and re.match(r"[ \t]*\r?\n|\s*(?:[,:\]}]|$)", text[at + 1 : at + 80]):
                    break
                else:
                    out.append(d)
                    at += 1
            yield "value", "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            at += 1
        elif found := _BARE.match(text, at):
            word = found[0]
            at = found.end()
            if word.lower() in _WORDS:
                yield "value", _WORDS[word.lower()]
            else:
                try:
                    yield "value", json.loads(word)
                except json.JSONDecodeError:
                    yield "value", word
        else:
            at += 1


def _recovered(text: str):
    """The first value of a damaged JSON text, by a stack of open arrays and objects.

    Missing and extra commas don't matter, a closing bracket closes what opened last of its kind and all within, an object's
    key without a value has null, and what is open at the end is closed there.
    """
    stack: list[tuple[object, list]] = []
    gap = object()

    def put(value) -> None:
        if stack:
            stack[-1][1].append(value)

    def closed():
        kind, items = stack.pop()
        if kind == "[":
            return [x for x in items if x is not gap]
        out, key, has = {}, None, False
        for i, x in enumerate(items):
            if x is gap:
                continue
            if i + 1 < len(items) and items[i + 1] is gap:
                if has:
                    out[key] = None
                key, has = x if isinstance(x, str) else json.dumps(x), True
            elif has:
                out[key], has = x, False
        if has:
            out[key] = None
        return out

    for mark, value in _tokens(text):
        if mark in "[{":
            stack.append((mark, []))
        elif mark in "]}":
            kind = "[" if mark == "]" else "{"
            if any(k == kind for k, _ in stack):
                while True:
                    last = stack[-1][0]
                    done = closed()
                    if not stack:
                        return done
                    put(done)
                    if last == kind:
                        break
        elif mark == ":":
            if stack and stack[-1][0] == "{":
                put(gap)
        elif mark == "value":
            put(value)
    done = None
    while stack:
        done = closed()
        put(done)
    return done


def repair_json(text: str | None):
    """The first JSON array or object of a reply; None if it has none.

    Prose and fences around it go. A valid value is taken as it is; a damaged one is recovered token by token: single and missing quotes,
    apostrophes inside strings, trailing and missing commas, other languages' constants, missing ends.
    """
    if not text:
        return None
    body = re.sub(r"```(?:json)?", "", text)
    start = min((i for i in (body.find("["), body.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(body, start)[0]
    except (json.JSONDecodeError, RecursionError):
        return _recovered(body[start:])


def fix_rows(value, required: tuple[str, ...], arrays: tuple[str, ...] = ()) -> list[dict]:
    """Rows of a reply with just the required keys: a lone object counts as one row, a key is taken by the one that
    contains its name, values become stripped text or lists of it; rows that lack a key, and repeats, go."""
    rows, seen = [], set()
    for item in value if isinstance(value, list) else [value]:
        if not isinstance(item, dict):
            continue
        keys = {k.strip().lower(): v for k, v in item.items()}
        out = {}
        for name in required:
            near = [k for k in keys if name.lower() == k] or [k for k in keys if name.lower() in k]
            if len(near) != 1:
                break
            v = keys[near[0]]
            if name in arrays:
                out[name] = [str(x).strip() for x in v] if isinstance(v, list) else [str(v).strip()]
            else:
                out[name] = str(v).strip()
        mark = json.dumps(out, sort_keys=True)
        if len(out) == len(required) and mark not in seen:
            seen.add(mark)
            rows.append(out)
    return rows


def flat_triplets(value) -> list[list[str]]:
    """From a nested reply, each item's first list of three strings."""

    def first(item):
        if isinstance(item, list):
            if len(item) == 3 and all(isinstance(x, str) for x in item):
                return item
            for x in item:
                if (found := first(x)) is not None:
                    return found
        if isinstance(item, dict):
            return first(list(item.values()))
        return None

    return [f for f in map(first, value if isinstance(value, list) else [value]) if f]


def flat_keywords(value, longest: int = 200) -> list[str]:
    """All strings of a nested reply of at most ``longest`` characters."""
    if isinstance(value, str):
        return [value] if len(value) <= longest else []
    if isinstance(value, dict):
        value = list(value.values())
    return [k for x in value for k in flat_keywords(x, longest)] if isinstance(value, list) else []


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def triplets_of(replies: pd.Series) -> pd.Series:
    """``flat_triplets`` of each repaired reply."""
    return replies.map(lambda t: flat_triplets(repair_json(t)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def keywords_of(replies: pd.Series) -> pd.Series:
    """``flat_keywords`` of each repaired reply."""
    return replies.map(lambda t: flat_keywords(repair_json(t)))


def key_name(key: Column) -> Column:
    """A reply's key as it is looked up: trimmed, lower-case."""
    return F.lower(F.trim(key))


@F.pandas_udf(T.ArrayType(T.StringType()))
def entities_of(replies: pd.Series) -> pd.Series:
    """Entities of a reply that is a comma list, or JSON with ``entities``, or a JSON list."""

    def parse(text: str | None) -> list[str]:
        value = repair_json(text)
        value = value.get("entities", []) if isinstance(value, dict) else value
        parts = (text or "").split(",") if value is None else value if isinstance(value, list) else []
        return [p.strip() for p in map(str, parts) if p.strip()]

    return replies.map(parse)


def penalties(repetition: Column) -> dict[str, Column]:
    """The frequency and presence penalties that stand for a repetition penalty where a service has none: of twice what it is over one, from 0 to 2, seven and three tenths."""
    value = F.least(F.greatest((repetition - 1) * 2, F.lit(0.0)), F.lit(2.0))
    return {"frequency": F.round(value * 0.7, 6), "presence": F.round(value * 0.3, 6)}


def choice_question(answer: Column, others: Column, place: Column) -> Column:
    """(prompt, choices, key): a question of four choices with the answer at ``place`` (0 to 3) among the others."""
    choices = F.concat(F.slice(others, F.lit(1), place), F.array(answer), F.slice(others, place + 1, F.size(others)))
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(F.chr(i.cast("int") + 65), F.lit(". "), c)), "\n")
    return F.struct(F.concat(F.lit("Which is it?\n"), lines).alias("prompt"), choices.alias("choices"), F.chr(place + 65).alias("key"))


def canonical_json(reply: Column, schema: str) -> Column:
    """A reply checked against a DDL schema, as JSON with the schema's fields in order; ``invalid`` if a field is missing or of another type, ``empty`` if a list of it is."""
    fields = T.StructType.fromDDL(schema)
    value = F.from_json(reply, fields)
    bad = reduce(lambda a, b: a | b, [value[f.name].isNull() for f in fields])
    lists = [F.size(value[f.name]) == 0 for f in fields if isinstance(f.dataType, T.ArrayType)]
    empty = reduce(lambda a, b: a | b, lists) if lists else F.lit(False)
    return F.when(value.isNull() | bad, "invalid").when(empty, "empty").otherwise(F.to_json(value))


def parse_triples(replies: DataFrame, reply: str, required: tuple[str, ...] = ("Head", "Relation", "Tail")) -> DataFrame:
    """``replies`` with ``rows``: the repaired reply as an array of structs of text; an unusable reply gives none."""
    kind = "array<struct<" + ", ".join(f"{k}: string" for k in required) + ">>"

    @F.pandas_udf(kind)
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fix_rows(repair_json(t), required))

    return replies.withColumn("rows", parse(reply))


def compile_schema(schema: dict) -> tuple[str, bool]:
    """A user's JSON schema of extraction rows as (Spark type, one-to-many): three text fields, or one of them an array."""
    item = schema.get("items", schema)
    fields = item["properties"]
    many = any(f.get("type") == "array" for f in fields.values())
    if not many and (len(fields) != 3 or not any(k.lower() == "relation" for k in fields)):
        raise ValueError("a one-to-one schema has three fields, a relation among them")
    kinds = {k: "array<string>" if f.get("type") == "array" else "string" for k, f in fields.items()}
    return "array<struct<" + ", ".join(f"`{k}`: {t}" for k, t in kinds.items()) + ">>", many


def react(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], reason: Callable[[DataFrame], DataFrame], rounds: int = 5) -> DataFrame:
    """(qid, answer, rounds): retrieve, reason, ask again, at most ``rounds`` times, all open questions together.

    ``retrieve`` takes (qid, query) and gives (qid, name); ``reason`` takes (qid, query, names) and gives (qid, answer, query),
    a null answer meaning that ``query`` is to be searched next. Contexts that a question has had aren't added again.
    """
    from ..functions.scratch import cut

    open_, contexts, done = questions.select("qid", "query"), None, None
    for r in range(1, rounds + 1):
        fresh = retrieve(open_)
        contexts = fresh if contexts is None else contexts.unionByName(fresh.join(contexts, ["qid", "name"], "left_anti"))
        contexts = cut(contexts.distinct(), "contexts")
        known = contexts.groupBy("qid").agg(F.array_sort(F.collect_set("name")).alias("names"))
        step = cut(reason(open_.join(known, "qid", "left")).select("qid", "answer", "query"), "react")
        closed = step if r == rounds else step.where("answer is not null")
        closed = closed.select("qid", "answer", F.lit(r).alias("rounds"))
        done = closed if done is None else done.unionByName(closed)
        open_ = step.where("answer is null").select("qid", "query")
        if r < rounds and not open_.limit(1).count():
            break
    return done


#: ``search for`` as a reasoner writes it, in either case.
SEARCH = r"(?i)search for\s*:?\s*"


def next_query(action: Column) -> Column:
    """What a reasoner's action asks to search for; null if it asks nothing."""
    return F.nullif(F.trim(F.regexp_extract(action, SEARCH + r"(.+)", 1)), F.lit(""))


def fit_context(passages: Column, budget: int) -> Column:
    """As many of the first passages as their characters fit ``budget``; at least the first, cut to it."""
    sizes = F.aggregate(passages, F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept")), lambda s, p: F.when(s["n"] + F.length(p) <= budget, F.struct((s["n"] + F.length(p)).alias("n"), F.concat(s["kept"], F.array(p)).alias("kept"))).otherwise(F.struct(F.lit(1 << 30).alias("n"), s["kept"].alias("kept"))))
    return F.when(F.size(sizes["kept"]) > 0, sizes["kept"]).otherwise(F.transform(F.slice(passages, 1, 1), lambda p: F.substring(p, 1, budget)))
