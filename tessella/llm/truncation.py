"""Problem 8: texts cut off at a field limit or in transfer.

A stack automaton reads each text and reports what is still open at its end:
brackets, quotes, markup, an entity, a link, an escape, a damaged character.
An open quote or tag counts where quotes or tags of its kind are normally
closed in its source.  A text that misses its terminator is held against the
corpus (whether its last word exists, and how seldom sentences end in it)
and against its source: of the texts of the source that miss a terminator,
how many are plainly cut and how many plainly whole, and whether the source
keeps many unfinished texts of just this length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import keep
from .textforms import shown

_TOKEN_RE = re.compile(r"[^\W_]+|[.!?…]")
_MARKER_RE = re.compile(r"(\s*(?:\[\s*(?:\.{2,}|…)\s*\]|\(\s*(?:\.{2,}|…)\s*\)))\s*$")
_DOTS_RE = re.compile(r"\s*(?:\.{2,}|…+)\s*$")
_LINK_RE = re.compile(r"(?:^|[\s(\[\"'>])((?:https?|www|http)(?:[:.]\S*)?)$")
_WHOLE_LINK_RE = re.compile(r"https?://[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?::\d+)?(?:/[^\s/?=&#]+)*/?(?:\?[\w.-]+=[\w.-]+(?:&[\w.-]+=[\w.-]+)*)?(?:#[\w.-]+)?$")
_ENTITY_RE = re.compile(r"&(?:#x?)?[A-Za-z0-9]{0,7}$")
_WHOLE_ENTITY_RE = re.compile(r"&(?:#x?)?[A-Za-z0-9]{2,8};$")
_ESCAPE_RE = re.compile(r"(?:\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|(?:%[0-9A-Fa-f]{2})+%[0-9A-Fa-f]?)$")
_TAG_RE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>")
_FACE_RE = re.compile(r"(?<!\w)[:;=8xX]-?[()\[\]DPpdO3/\\|]+|(?<!\w)<3|(?<!\w)\d{1,2}\)|(?m:^\s*[a-z]\))")
_MARK_ROOM = 12
_VOID = {"br", "hr", "img", "p", "li", "input", "meta", "link"}
_CLOSES = {")": "([{", "]": "([{", "}": "([{", "»": "«", "”": "“„"}
_PAIR = {")": "(", "]": "[", "}": "{"}
_OPENS = set("([{«“„")
_SIGNS = set("([{«“„\"<")
_SIGN_RE = re.compile(r'[(){}\[\]«»“”„"]')
_ENDS = set(".!?…。！？")


def still_open(t: str) -> tuple[list[str], set[str]]:
    """The automaton: the stack of brackets, quotes and tags a text leaves open, outermost first, and the kinds of quotes and tags it closes.

    Tags stand as `<name`.  A straight quote opens after a blank or an opening
    sign and before a visible character, else it closes.  Emoticons and the
    brackets of numbered items are no brackets.
    """
    if _SIGNS.isdisjoint(t):
        return [], set()
    stack: list[str] = []
    closed: set[str] = set()

    def close(kinds: str | tuple[str, ...]) -> None:
        if any(x in kinds for x in stack):
            while (x := stack.pop()) not in kinds:
                pass
            closed.add(x)

    def signs(part: str) -> None:
        part = _FACE_RE.sub(lambda m: " " * len(m.group()), part)
        for m in _SIGN_RE.finditer(part):
            i, c = m.start(), m.group()
            if c == "“" and "„" in stack:
                close("„")
            elif c in _OPENS:
                stack.append(c)
            elif c in _CLOSES:
                close(_PAIR.get(c) or _CLOSES[c])
            elif c == '"':
                if (i == 0 or part[i - 1].isspace() or part[i - 1] in "([{-–—/«“„") and i + 1 < len(part) and not part[i + 1].isspace():
                    stack.append('"')
                else:
                    close('"')

    at = 0
    for m in _TAG_RE.finditer(t) if "<" in t else ():
        signs(t[at : m.start()])
        at = m.end()
        name = "<" + m.group(2).lower()
        if m.group(1):
            close((name,))
        elif name[1:] not in _VOID and not m.group(3).endswith("/"):
            stack.append(name)
    signs(t[at:])
    return stack, closed


def _loose_end(t: str) -> str:
    """What the last characters of a text, blanks stripped, leave open: a damaged character, a mark of omission, a link, an entity, an escape, a tag."""
    if t[-1] == "�" or "\ud800" <= t[-1] <= "\udfff" or t[-1] == "‍":
        return "character"
    t = shown(t).rstrip() if not t.isascii() else t
    if not t:
        return ""
    if t[-1] in ")]" and _MARKER_RE.search(t):
        return "mark"
    if t.endswith(("..", "…")):
        t = _DOTS_RE.sub("", t)
        if not t:
            return ""
    word = t.rsplit(None, 1)[-1]
    link = _LINK_RE.search(" " + word)
    if link and not _WHOLE_LINK_RE.match(link.group(1)):
        return "link"
    if "&" in word and not link and _ENTITY_RE.search(word):
        return "entity"
    if ("\\" in word or "%" in word) and _ESCAPE_RE.search(word):
        return "escape"
    tag = t.rfind("<")
    if tag >= 0 and ">" not in t[tag:] and (tag == len(t) - 1 or t[tag + 1].isalpha() or t[tag + 1] in "/!"):
        return "markup"
    return ""


def open_at_end(text: str) -> str:
    """What the end of a text leaves open: the name of the first finding, or the empty string.

    An open bracket, quote or tag is a finding unless the text ends with a terminator.
    """
    return _read(text)[0]


_BRACKETS = {"(", "[", "{"}


def _read(text: str) -> tuple[str, str, set[str]]:
    """What is open at the end, the quote or tag concerned if it is one, and the kinds of quotes and tags closed."""
    t = text.rstrip()
    if not t:
        return "", "", set()
    found = _loose_end(t)
    stack, closed = still_open(t)
    if found or not stack or t[-1] in _ENDS and not t.endswith(("..", "…")):
        return found, "", closed
    if not _BRACKETS.isdisjoint(stack):
        return "bracket", "", closed
    return "markup" if stack[-1][0] == "<" else "quote", stack[-1], closed


def _last_tokens(t: str) -> list[str]:
    """The last words and terminators of a text, four or all."""
    room = 80
    while True:
        part = t[-room:]
        ws = _TOKEN_RE.findall(part)
        if room >= len(t):
            return ws
        if len(ws) > 5:
            return ws[1:]  # the first may have lost its beginning
        room *= 4


def ending(text: str | None) -> tuple[str, str, str, str, bool, bool, str, list[str]] | None:
    """None for a text that ends with a terminator or is blank; else what is open, the last three words as written, whether a hanging mark ends the text, whether dots do, the open quote or tag, and the kinds closed."""
    if not text or not text.strip():
        return None
    found, kind, closed = _read(text)
    seen = text.rstrip()
    seen = shown(seen).rstrip() if not seen.isascii() else seen
    t = seen
    if t and t[-1] in ")]":
        t = _MARKER_RE.sub("", t)
    if t.endswith(("..", "…")) or len(t) < len(seen):
        t = _DOTS_RE.sub("", t)
    t = t.rstrip()
    dotted = len(t) < len(seen)
    if not dotted and t.endswith(";"):
        t = _WHOLE_ENTITY_RE.sub("", t).rstrip()
    if not t:
        return None
    last = t[-1]
    if not found and not dotted and not last.isalnum() and last not in ",;:-–—'’_/&%#@$<([{«“":
        return None  # a terminator, an emoji, a closing bracket or quote
    ws = _last_tokens(t)
    words = [w for w in ws[-4:] if w[0] not in _ENDS]
    if not words:
        return (found, "", "", "", False, dotted, kind, sorted(closed)) if found else None
    if len(words) == 1 and len(ws) == 1 and not found:
        return None  # a post of one word
    words = ["", "", *words][-3:]
    return found, words[0], words[1], words[2], last in ",-–—'’_&([{«“", dotted, kind, sorted(closed)


def _name_like(token: str, before: str) -> bool:
    return token[0].isupper() and not token.isupper() and bool(before) and before[0] not in _ENDS


def _facts(texts: list[str | None]) -> dict[str, list[int]]:
    """Of words and pairs of words: how often they occur, end a sentence, and come before a name.

    The last word of a text without terminator is not counted.
    """
    seen: Counter = Counter()
    for t in texts:
        if not t:
            continue
        ts = _TOKEN_RE.findall(shown(t) if not t.isascii() else t)
        if ts and (ts[-1] == "…" or ts[-2:] == [".", "."]):
            while ts and ts[-1] in ".…":
                ts.pop()  # dots may mark a cut: the word before them ends nothing
        if len(ts) < 2:
            continue
        low = list(map(str.lower, ts))
        mark = [w in _ENDS for w in ts]
        # a word as the context of the next: itself, a name, or the terminator
        now = [x if x == w or after else "<n>" if _name_like(w, "x") else x for w, x, after in zip(ts, low, [True, *mark])]
        seen.update(compress(zip(["", *now], now, low, mark[1:]), [not m for m in mark[:-1]]))
    out: dict[str, list[int]] = {}
    for (k, x, w, end), c in seen.items():
        for of in (w, f"{k} {x}"):
            f = out.get(of)
            if f is None:
                f = out[of] = [0, 0, 0]
            f[0] += c
            if end:
                f[1] += c
        if x == "<n>":
            # how often a word comes before a name
            if k not in out:
                out[k] = [0, 0, 0]
            out[k][2] += c
    return {k: f for k, f in out.items() if f[0]}


_END_COLUMNS = "source string, chars long, bytes long, ended boolean, blank boolean, open string, w3 string, w2 string, w1 string, hanging boolean, dotted boolean, kind string, closed array<string>"
_FACT_COLUMNS = "word string, n long, ends long, names long"


def _read_texts(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """One pass over the texts: a row per text with its ending, and rows of word facts (`word` not null), added up within a batch."""
    kind = df.schema[key].dataType.simpleString()
    none = ("", "", "", "", False, False, "", [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            texts = b.column(1).to_pylist()
            for t, s in zip(texts, b.column(2).to_pylist()):
                blank = not t or not t.strip()
                e = ending(t)
                raw = len(t.encode("utf-8", "surrogatepass")) if t and not t.isascii() else len(t or "")
                if e is None and t:  # what it closes counts for the baseline of its source all the same
                    rows.append((s or "", len(t), raw, not blank, blank, *none[:-1], sorted(still_open(t)[1])))
                else:
                    rows.append((s or "", len(t) if t else 0, raw, False, blank, *(e or none)))
            m, f = len(rows), _facts(texts)
            facts = list(zip(*f.values())) or [[], [], []]
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.string()] * 4, pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.string())]
            cols = list(zip(*rows)) if rows else [[]] * len(types)
            out = [pa.array([*b.column(0).to_pylist(), *[None] * len(f)], b.column(0).type)]
            out += [pa.array([*c, *[None] * len(f)], x) for c, x in zip(cols, types)]
            out += [pa.array([*[None] * m, *f], pa.string()), *(pa.array([*[None] * m, *x], pa.int64()) for x in facts)]
            yield pa.RecordBatch.from_arrays(out, ["k", *(c.split()[0] for c in (_END_COLUMNS + ", " + _FACT_COLUMNS).split(", "))])

    return df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")).mapInArrow(run, f"k {kind}, {_END_COLUMNS}, {_FACT_COLUMNS}")


def _usually_closed(ends: DataFrame) -> DataFrame:
    """`source`, `kind`: quotes and tags that the texts of a source close at least three times of four; of a source with fewer than eight of the kind all sources decide."""
    seen = ends.select("source", F.explode("closed").alias("kind"), F.lit(1).alias("c"), F.lit(0).alias("o")).unionByName(ends.where("kind <> ''").select("source", "kind", F.lit(0).alias("c"), F.lit(1).alias("o")))
    own = seen.groupBy("source", "kind").agg(F.sum("c").alias("c"), F.sum("o").alias("o"))
    every = own.groupBy("kind").agg(F.sum("c").alias("ac"), F.sum("o").alias("ao"))
    few = F.col("c") + F.col("o") < 8
    return own.join(every, "kind").where(F.when(few, F.col("ac") >= 3 * F.col("ao")).otherwise(F.col("c") >= 3 * F.col("o"))).select("source", "kind")


def field_limits(ends: DataFrame, least: int = 4, times: float = 6.0) -> DataFrame:
    """`source`, `unit`, `size`: lengths at which a source holds far more unfinished texts than near them.

    Baseline per source: `size` is a limit if at least `least` texts with
    different endings have it and three more than `times` as many as the mean
    of the twenty lengths around it.
    """
    sizes = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))
    long = ends.where("not blank and not ended").select("source", F.xxhash64("w3", "w2", "w1").alias("end"), F.explode(sizes).alias("x")).select("source", "end", "x.*").distinct()
    counts = long.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    # a window over counts: as many rows as lengths occur
    near = Window.partitionBy("source", "unit").orderBy("size").rangeBetween(-10, 10)
    around = (F.sum("n").over(near) - F.col("n")) / 20.0
    return counts.withColumn("around", around).where((F.col("n") >= least) & (F.col("n") > 3 + times * F.col("around"))).select("source", "unit", "size")


def judged(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seldom: float = 0.02) -> DataFrame:
    """Every row with its `source`, `cut` and the `reason`.

    Null, empty and blank texts are never cut.  A text that ends with a
    terminator, an emoji, a closing bracket or a signature is not cut unless
    the automaton finds something open.  Repeated rows come out each time;
    a null source counts as the source ''.
    """
    read = keep(_read_texts(df, key, text, source).withColumn("_row", F.monotonically_increasing_id()))
    ends = keep(read.where("word is null").drop("word", "n", "ends", "names"))
    facts = keep(read.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("names").alias("names")))
    # an open quote or tag that its source does not usually close says nothing
    closing = _usually_closed(ends).withColumn("_closing", F.lit(True))
    left_open = ends.where("kind <> ''").join(closing, ["source", "kind"], "left").withColumn("open", F.when(F.col("_closing"), F.col("open")).otherwise("")).select(*ends.columns)
    ends = ends.where("kind = ''").unionByName(left_open)
    # how often words that begin with these letters occur
    begun = facts.where("n >= 3 and word not like '% %' and length(word) > 1").select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.concat(F.lit("^"), F.substring(F.col("word"), F.lit(1), i)))).alias("word"))
    facts = facts.unionByName(begun.groupBy("word").agg(F.sum("n").alias("n")).withColumns({"ends": F.lit(0).cast("long"), "names": F.lit(0).cast("long")}))
    doubtful = ends.where("not blank and not ended and open = '' and w1 <> ''")
    low = [F.lower(F.col(c)) for c in ("w3", "w2", "w1")]
    is_name = lambda c, b: (F.col(c).rlike(r"^\p{Lu}") & ~F.col(c).rlike(r"^\p{Lu}+$") & (F.col(b) != ""))
    key2 = F.when(is_name("w2", "w3"), F.lit("<n>")).otherwise(low[1])
    wanted = doubtful.select("_row", F.explode(F.array(
        F.struct(F.lit("w").alias("what"), low[2].alias("word")),
        F.struct(F.lit("p").alias("what"), low[1].alias("word")),
        F.struct(F.lit("b").alias("what"), F.concat_ws(" ", key2, low[2]).alias("word")),
        F.struct(F.lit("m").alias("what"), F.concat_ws(" ", key2, F.lit("<n>")).alias("word")),
        F.struct(F.lit("x").alias("what"), F.concat(F.lit("^"), low[2]).alias("word")),
    )).alias("x")).select("_row", "x.*")
    known = wanted.join(facts, "word").groupBy("_row").agg(*[F.max(F.when(F.col("what") == w, F.struct("n", "ends", "names"))).alias(w) for w in "wpbmx"])
    limits = field_limits(ends)
    # a text marked by dots ends a little before the limit
    reach = limits.where("unit = 'chars'").select("source", F.explode(F.sequence(F.col("size") - _MARK_ROOM, F.col("size"))).alias("chars"), "size").groupBy("source", "chars").agg(F.max(F.col("chars") == F.col("size")).alias("_at_chars"))
    # a character that the limit would split is dropped whole
    exact = limits.where("unit = 'bytes'").select("source", F.explode(F.sequence(F.col("size") - 3, F.col("size"))).alias("bytes")).distinct().withColumn("_at_bytes", F.lit(True))
    j = keep(doubtful.join(known, "_row", "left"))
    n = lambda w, f: F.coalesce(F.col(w)[f], F.lit(0))
    slot = (n("p", "names") / F.greatest(n("p", "n"), F.lit(1)) > 0.3) | is_name("w1", "w2")

    def reason(seldom: Column) -> Column:
        return (
            F.when(F.col("hanging"), "hanging")
            .when(F.col("w1").rlike(r"^\p{N}+$"), "")
            .when((n("w", "n") == 0) | ((n("w", "n") < 3) & (n("b", "n") == 0)), F.when(~slot & (n("x", "n") >= 3), "word").when(slot & (n("m", "n") >= 10) & (n("m", "ends") < seldom * n("m", "n")), "sentence").otherwise(""))
            .when(n("b", "n") >= 5, F.when(n("b", "ends") < seldom * n("b", "n"), "sentence").otherwise(""))
            .when(n("w", "ends") < seldom * n("w", "n"), "sentence")
            .otherwise("")
        )

    # the baseline of a source: of its texts without a terminator, how many are plainly cut and how many plainly whole
    plain = j.groupBy("source").agg(F.sum((reason(F.lit(seldom)) != "").cast("double")).alias("c"), F.count(F.lit(1)).alias("a"))
    all_cut, everything = (x or 0 for x in plain.agg(F.sum("c"), F.sum("a")).first())
    odds = lambda c, a: (c + 0.5) / (a - c + 0.5)
    own = odds(F.col("c") + 20 * all_cut / max(1, everything), F.col("a") + 20) / odds(all_cut, everything)
    base = plain.select("source", (seldom * F.least(F.lit(2.0), F.greatest(F.lit(0.5), own))).alias("_seldom"))
    tested = j.join(base, "source").withColumn("reason", reason(F.col("_seldom"))).select("k", "source", "chars", "bytes", "dotted", "reason")
    rest = ends.where("blank or ended or open <> '' or w1 = ''").select("k", "source", F.col("open").alias("reason"))
    # the field limit decides for texts that might be whole by their last word
    limited = tested.join(reach, ["source", "chars"], "left").join(exact, ["source", "bytes"], "left")
    at_limit = F.coalesce(F.col("_at_chars"), F.lit(False)) | (F.col("dotted") & F.col("_at_chars").isNotNull()) | F.coalesce("_at_bytes", F.lit(False))
    limited = limited.withColumn("reason", F.when((F.col("reason") == "") & at_limit, "limit").otherwise(F.col("reason")))
    return limited.select("k", "source", "reason").unionByName(rest).select(F.col("k").alias(key), "source", (F.col("reason") != "").alias("cut"), "reason")


def by_source(judged_rows: DataFrame) -> DataFrame:
    """Per source: documents, cut documents and their share."""
    return judged_rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("cut").cast("long")).alias("cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("share"))
