"""Prompts, captions, token masks and other string and array functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = -100

#: Prompt templates: style, system text, role names, separators. Fixed values of prompt formats.
TEMPLATES = {
    "default": ("two", "Here is a conversation between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.", ("USER", "ASSISTANT"), " ", "</s>"),
    "llama2": ("llama2", "", ("USER", "ASSISTANT"), "<s>", "</s>"),
    "plain": ("plain", "", ("", ""), "\n", "\n"),
    "single": ("single", "", ("Human", "Assistant"), "###", ""),
}


def templates(spark) -> DataFrame:
    """The templates as a dimension table."""
    rows = [(k, t[0], t[1], t[2][0], t[2][1], t[3], t[4]) for k, t in TEMPLATES.items()]
    return spark.createDataFrame(rows, "template string, style string, system string, user string, assistant string, sep string, sep2 string")


def prompt(turns: Column, style: str, system: str = "", sep: str = "", sep2: str = "") -> Column:
    """Of an ordered array of structs (role, text): the prompt in a style. A null text leaves only the role's opening."""
    at = lambda i: F.when(i % 2 == 0, F.lit(sep)).otherwise(F.lit(sep2))
    if style == "single":
        parts = F.transform(turns, lambda t: F.when(t["text"].isNotNull(), F.concat(t["role"], F.lit(": "), t["text"], F.lit(sep))).otherwise(F.concat(t["role"], F.lit(":"))))
        return F.concat(F.lit(system + sep), F.array_join(parts, ""))
    if style == "two":
        parts = F.transform(turns, lambda t, i: F.when(t["text"].isNotNull(), F.concat(t["role"], F.lit(": "), t["text"], at(i))).otherwise(F.concat(t["role"], F.lit(":"))))
        return F.concat(F.lit(system + sep), F.array_join(parts, ""))
    if style == "plain":
        parts = F.transform(turns, lambda t, i: F.when(t["text"].isNotNull(), F.concat(t["text"], at(i))).otherwise(F.lit("")))
        return F.concat(F.lit(system), F.array_join(parts, ""))
    if style == "llama2":
        head = F.lit(f"<<SYS>>\n{system}\n<</SYS>>\n\n" if system else "")

        def one(t, i):
            text = F.when(i == 0, F.concat(head, t["text"])).otherwise(t["text"])
            said = F.when(i % 2 == 0, F.concat(F.lit(sep), F.lit("[INST] "), text, F.lit(" [/INST]"))).otherwise(F.concat(F.lit(" "), text, F.lit(" "), F.lit(sep2)))
            return F.when(t["text"].isNotNull(), said).otherwise(F.lit(""))

        whole = F.array_join(F.transform(turns, one), "")
        return F.when(F.startswith(whole, F.lit(sep)), F.substring(whole, len(sep) + 1, 1 << 30)).otherwise(whole) if sep else whole
    raise ValueError(style)


def conversations(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): each conversation's ordered array of (role, text)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("text"))))
    return turns.groupBy(conv).agg(F.transform(rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def grounded_caption(caption: Column, spans: Column) -> Column:
    """Caption with each distinct span (struct start, end; sorted by start here) as ``<p>text</p><roi><ground_box>*n</roi>``, n being how often
    it is listed. Spans within text already passed are left out."""
    order = F.array_sort(F.array_distinct(spans))
    count = lambda s: F.size(F.filter(spans, lambda x: x == s))
    cut = lambda a, b: F.substr(caption, a + 1, b - a)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc, s):
        mark = F.concat(acc["text"], cut(acc["at"], s["start"]), F.lit("<p>"), cut(s["start"], s["end"]), F.lit("</p><roi>"), F.repeat(F.lit("<ground_box>"), count(s)), F.lit("</roi>"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].cast("int").alias("at"), mark.alias("text"))).otherwise(acc)

    return F.aggregate(order, start, step, lambda a: F.concat(a["text"], F.substr(caption, a["at"] + 1, F.length(caption))))


def span_question(caption: Column, exps: Column, chosen: Column) -> Column:
    """Question and boxes of a referring expression: of the array of [start, end, x1, y1, x2, y2, ...], all that share the chosen one's span."""
    same = F.filter(exps, lambda e: (e[0] == chosen[0]) & (e[1] == chosen[1]))
    phrase = F.substr(caption, chosen[0].cast("int") + 1, (chosen[1] - chosen[0]).cast("int"))
    return F.struct(phrase.alias("phrase"), F.transform(same, lambda e: F.slice(e, 3, 4)).alias("boxes"), F.repeat(F.lit("<ground_box>"), F.size(same)).alias("answer"))


def detection_question(label: Column, n: Column) -> Column:
    name = F.lower(F.trim(label))
    return F.struct(F.concat(F.lit("Locate all "), name, F.lit(" in the image.")).alias("question"), F.concat(F.lit("<p>"), name, F.lit("</p><roi>"), F.repeat(F.lit("<ground_box>"), n), F.lit("</roi>")).alias("answer"))


def referring_question(expression: Column) -> Column:
    return F.struct(F.concat(F.lit("Locate "), F.lower(F.trim(expression)), F.lit(" in the image.")).alias("question"), F.concat(F.lit("<p>"), F.lower(F.trim(expression)), F.lit("</p><roi><ground_box></roi>")).alias("answer"))


def capitalised(x: Column) -> Column:
    """Trimmed, lower case, the first letter upper case (not every word)."""
    t = F.lower(F.trim(x))
    return F.concat(F.upper(F.substr(t, F.lit(1), F.lit(1))), F.substr(t, F.lit(2), F.length(t)))


def region_rounds(captions: Column) -> Column:
    """Question and answer turns over an ordered array of region captions."""
    return F.flatten(F.transform(captions, lambda c: F.array(F.struct(F.lit("user").alias("role"), F.lit("Describe the region <refer_box>.").alias("text")), F.struct(F.lit("assistant").alias("role"), capitalised(c).alias("text")))))


def instruction_turns(turns: Column) -> Column:
    """Of an array of texts: answers (odd places) between ``<sep>`` marks, questions with the grounding tag; null unless questions and answers pair."""
    said = F.transform(turns, lambda t, i: F.when(i % 2 == 1, F.concat(F.lit("<sep>"), t, F.lit("<sep>"))).otherwise(F.concat(F.lit("[grounding]"), t)))
    return F.when(F.size(turns) % 2 == 0, said)


def gather_boxes(boxes: Column, indices: Column) -> Column:
    """Boxes by an array of arrays of positions, in order."""
    return F.transform(F.flatten(indices), lambda i: F.get(boxes, i))


def without_image_tag(x: Column) -> Column:
    return F.trim(F.replace(F.replace(x, F.lit("<image>"), F.lit("")), F.lit("\n"), F.lit(" ")))


def clean_caption(x: Column) -> Column:
    """Newlines go, doubled spaces halve once, tags go, white space collapses, outer quotes go."""
    t = F.replace(F.replace(x, F.lit("\n"), F.lit("")), F.lit("  "), F.lit(" "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "(?d)<.*?>", ""), " +", " "))
    return F.btrim(t, F.lit("'"))


# token arrays ------------------------------------------------------------------------------------------


def running_count(ids: Column, token: int) -> Column:
    """How often ``token`` occurs up to and including each place."""
    zero = F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<int>)").alias("a"))
    add = lambda s, x: F.struct((s["n"] + F.when(x == token, 1).otherwise(0)).alias("n"), F.concat(s["a"], F.array(s["n"] + F.when(x == token, 1).otherwise(0))).alias("a"))
    return F.aggregate(ids, zero, add, lambda s: s["a"])


def label_mask(ids: Column, sep: int, eos: int, ignore: int = IGNORE) -> Column:
    """Struct (ids, labels): tokens outside separator pairs are masked; end tokens but the first keep their label; separators go from both."""
    seps, ends = running_count(ids, sep), running_count(ids, eos)
    lab = F.transform(ids, lambda x, i: F.when((x == eos) & (F.get(ends, i) > 1), x).when(F.get(seps, i) % 2 == 1, x).otherwise(F.lit(ignore)))
    keep = lambda arr: F.filter(arr, lambda _, i: F.get(ids, i) != sep)
    return F.struct(keep(ids).alias("ids"), keep(lab).alias("labels"))


def expand_placeholders(ids: Column, labels: Column, image: int, n_image: int, region: int, n_region: int, pad: int, box_token: int, ignore: int = IGNORE) -> Column:
    """Struct (ids, labels): up to the first pad, the image token becomes ``n_image`` and the region token 2 * ``n_region`` places, labels masked there."""
    end = F.array_position(ids, pad)
    cut = lambda a: F.when(end > 0, F.slice(a, F.lit(1), (end - 1).cast("int"))).otherwise(a)
    wide = lambda a, of: F.flatten(F.zip_with(cut(ids), cut(a), lambda x, y: F.when(x == image, F.array_repeat(F.lit(image if of else ignore), n_image)).when(x == region, F.array_repeat(F.lit(box_token if of else ignore), 2 * n_region)).otherwise(F.array(y))))
    return F.struct(wide(ids, True).alias("ids"), wide(labels, False).alias("labels"))


def fill_placeholders(ids: Column, token: int, values: Column) -> Column:
    """The k-th ``token`` becomes the k-th value (kept where values run out)."""
    n = running_count(ids, token)
    return F.transform(ids, lambda x, i: F.when(x == token, F.coalesce(F.get(values, F.get(n, i) - 1), x)).otherwise(x))


def box_tokens(ids: Column, region_tokens: list[int], n_boxes: Column) -> Column:
    """Places in the region list of the ids that are in it, below the number of boxes."""
    table = F.array(*map(F.lit, region_tokens))
    return F.filter(F.transform(ids, lambda x: (F.array_position(table, x) - 1).cast("int")), lambda i: (i >= 0) & (i < n_boxes))


def split_embedding(ids: Column, base: int) -> Column:
    """Struct (old, new): ids below the base vocabulary, and those above counted from it (0 elsewhere)."""
    return F.struct(F.transform(ids, lambda x: F.when(x < base, x).otherwise(0)).alias("old"), F.transform(ids, lambda x: F.when(x >= base, x - base).otherwise(0)).alias("new"))


# judging, chat, names, versions ------------------------------------------------------------------------


def parse_scores(review: Column) -> Column:
    """The first line's two numbers, commas being spaces; [-1, -1] otherwise."""
    line = F.replace(F.element_at(F.split(review, "\n"), 1), F.lit(","), F.lit(" "))
    parts = F.filter(F.split(line, " "), lambda x: x != "")
    nums = F.transform(parts, lambda x: x.try_cast("double"))
    return F.when((F.size(nums) == 2) & ~F.exists(nums, lambda x: x.isNull()), nums).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def judge_prompt(captions: Column, instances: Column, question: Column, one: Column, two: Column, role: Column, rule: Column) -> Column:
    """Context, question, both answers and the rule. ``instances``: array of (category, bbox)."""
    boxes = F.array_join(F.transform(instances, lambda i: F.concat(i["category"], F.lit(": ["), F.array_join(F.transform(i["bbox"], lambda v: v.cast("string")), ", "), F.lit("]"))), "\n")
    answer = lambda n, a: F.concat(F.lit(f"[{n} "), role, F.lit("]\n"), a, F.lit(f"\n\n[End of {n} "), role, F.lit("]\n\n"))
    return F.concat(F.lit("[Context]\n"), F.array_join(captions, "\n"), F.lit("\n\n"), boxes, F.lit("\n\n[Question]\n"), question, F.lit("\n\n"), answer("Assistant 1", one), answer("Assistant 2", two), F.lit("[System]\n"), rule, F.lit("\n\n"))


def code_block_text(x: Column) -> Column:
    """Escapes undone in the code parts between fence lines."""
    parts = F.split(x, "\n```")
    fixed = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(F.replace(p, F.lit("\\_"), F.lit("_")), F.lit("\\*"), F.lit("*"))).otherwise(p))
    return F.array_join(fixed, "\n```")


def log_name(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit("-conv.json"))


def input_guard(text: Column, image: Column) -> Column:
    """Chat input: null if there is neither text nor image; cut to 1536 characters, 1200 with an image, which adds its tag."""
    cut = F.when(image.isNotNull(), F.substr(text, F.lit(1), F.lit(1200))).otherwise(F.substr(text, F.lit(1), F.lit(1536)))
    tagged = F.when(image.isNotNull() & ~F.contains(cut, F.lit("<image>")), F.concat(cut, F.lit("\n<image>"))).otherwise(cut)
    return F.when((F.length(text) > 0) | image.isNotNull(), tagged)


def version_key(v: Column) -> Column:
    """Comparable array: four release numbers, then the stage (a -3, b -2, rc -1, dev -4, post 1, final 0) and its number."""
    body = F.regexp_extract(v, r"^v?(\d+(?:\.\d+)*)", 1)
    nums = F.transform(F.split(body, r"\."), lambda x: x.cast("int"))
    four = F.slice(F.concat(nums, F.array_repeat(F.lit(0), 4)), 1, 4)
    tag = F.regexp_extract(v, r"(a|b|rc|dev|post)\.?\d*(?:\+.*)?$", 1)
    num = F.coalesce(F.regexp_extract(v, r"(?:a|b|rc|dev|post)\.?(\d+)(?:\+.*)?$", 1).try_cast("int"), F.lit(0))
    stage = F.when(tag == "a", -3).when(tag == "b", -2).when(tag == "rc", -1).when(tag == "dev", -4).when(tag == "post", 1).otherwise(0)
    return F.concat(four, F.array(stage, F.when(stage == 0, 0).otherwise(num)))


def rewritten(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Patterns replaced one after the other."""
    for pattern, to in rules:
        x = F.regexp_replace(x, pattern, to)
    return x


def cast_elements(x: Column, kind: str) -> Column:
    return F.transform(x, lambda v: v.cast(kind))


def matches_keyword(name: Column, keywords: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(name, k))


def split_by_lengths(flat: Column, lengths: Column) -> Column:
    """Consecutive parts of an array, of the lengths given."""
    before = lambda i: F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, v: a + v.cast("int"))
    return F.transform(lengths, lambda n, i: F.slice(flat, before(i) + 1, n.cast("int")))


def run_lengths(bits: Column) -> Column:
    """Column-major run lengths of a 0/1 array, zeros first: distances between the places where the value changes, in one pass."""
    n = F.size(bits)
    before = lambda x, k: F.concat(F.array(F.lit(0)), F.slice(x, 1, k - 1))
    turns = F.filter(F.zip_with(bits, before(bits, F.greatest(n, F.lit(1))), lambda x, p: x != p), lambda t: t.isNotNull())
    ends = F.concat(F.filter(F.transform(turns, lambda t, i: F.when(t, i).otherwise(-1)), lambda i: i >= 0), F.array(n))
    return F.zip_with(ends, before(ends, F.size(ends)), lambda e, p: e - p)


def from_run_lengths(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat((i % 2).cast("int"), n)))


def valid_polygons(polys: Column) -> Column:
    return F.filter(polys, lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))


def uri_scheme(uri: Column) -> Column:
    """``s3`` of ``cluster:s3://...``; null without a scheme."""
    return F.nullif(F.regexp_extract(uri, r"^(?:[^:/]*:)?([^:/]+)://", 1), F.lit(""))


# configuration text (driver side, no table) -------------------------------------------------------------


def parse_value(text: str):
    """int, float, bool, None, quoted string, or a nested list/tuple in brackets, parentheses or bare commas."""
    t = text.strip()
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if t == "None":
        return None
    if len(t) > 1 and t[0] == t[-1] and t[0] in "'\"":
        return t[1:-1]
    inner, tup = (t[1:-1], t[0] == "(") if t[:1] + t[-1:] in ("[]", "()") else (t, False)
    depth, parts, at = 0, [], 0
    for i, ch in enumerate(inner):
        depth += (ch in "[(") - (ch in "])")
        if ch == "," and not depth:
            parts.append(inner[at:i])
            at = i + 1
    if not parts and inner == t:
        return t
    values = [parse_value(p) for p in [*parts, inner[at:]] if p.strip()]
    return tuple(values) if tup else values


def merge_config(base: dict, over: dict) -> dict:
    """``over`` into ``base``: dicts merge, a dict with ``_delete_`` replaces, string numbers index lists, dotted keys descend."""
    out = dict(base)
    for key, v in over.items():
        head, _, rest = key.partition(".")
        v = {rest: v} if rest else v
        old = out.get(head)
        if isinstance(old, list) and isinstance(v, dict):
            new = list(old)
            for i, x in v.items():
                new[int(i)] = merge_config(new[int(i)], x) if isinstance(x, dict) and isinstance(new[int(i)], dict) else x
            out[head] = new
        elif isinstance(old, dict) and isinstance(v, dict) and not v.get("_delete_"):
            out[head] = merge_config(old, v)
        else:
            out[head] = merge_config({}, {k: x for k, x in v.items() if k != "_delete_"}) if isinstance(v, dict) else v
    return out


def substitute(text: str, values: dict[str, object]) -> str:
    """``{{ name }}`` (dots descend) by values."""

    def one(m: re.Match) -> str:
        v = values
        for part in m[1].split("."):
            v = v[part]
        return str(v)

    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", one, text)
