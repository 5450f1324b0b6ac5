"""Cut documents and pages into chunks: by headings, within a budget of words and tags, with overlap and source offsets.

A text is read once, unit by unit: a tag, a word, or a whole script, style sheet or comment, each with the blanks behind it. A
heading (an `<h1>` to `<h6>` tag, or `#` to `######` at the start of a line) opens a section, and no chunk reaches over the start of one. The own parts
of a text's chunks, in order, are the text, character by character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from millrace.errors import InvalidInput
from millrace.session import require_columns

BLANK = r"[\x20\x09-\x0D]"
UNIT = (rf"(?is)(?:<!--.*?-->|<script(?:{BLANK}[^>]*)?>.*?</script[^>]*>|<style(?:{BLANK}[^>]*)?>.*?</style[^>]*>|<[^>]*>"
        rf"|[^\x20\x09-\x0D<]+|<){BLANK}*|{BLANK}+")
OPENING = rf"(?i)^<h([1-6])(?:{BLANK}|>|/)"
BUDGET, OVERLAP = 256, 32

CHUNK = T.StructType([T.StructField("no", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("lead", T.LongType()),
                      T.StructField("units", T.IntegerType()), T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())])
# Characters of chunks that are handed on together.
_BATCH = 4_000_000

_unit, _opening, _marks = re.compile(UNIT), re.compile(OPENING), re.compile(r"(#{1,6})[\x20\x09]")
_tag, _closing = re.compile(r"<[^>]*>"), re.compile(r"(?i)^</h[1-6]")


def _level(text: str, start: int, unit: str) -> tuple[int, bool]:
    """(level, by marks) of the heading that a unit opens; level 0 if it opens none."""
    if unit[0] == "<":
        found = _opening.match(unit)
        return (int(found[1]), False) if found else (0, False)
    if unit[0] == "#" and (start == 0 or text[start - 1] == "\n") and (found := _marks.match(unit)):
        return len(found[1]), True
    return 0, False


def cut(text: str, budget: int, overlap: int) -> Iterator[tuple]:
    """(no, start, lead, units, heading, text) of each chunk of one text."""
    titles: list[tuple[int, str]] = []
    places: list[int] = []  # where the chunk's units begin, the repeated ones first
    own = no = 0  # how many of them are repeated
    title, by_marks, level = None, False, 0

    def chunk(end: int) -> tuple:
        start = places[own]
        return no, start, start - places[0], len(places), " > ".join(t for _, t in titles), text[places[0] : end]

    for found in _unit.finditer(text):
        at, unit = found.start(), found[0]
        opens, marks = _level(text, at, unit)
        if places and (opens or len(places) == budget):
            # A title that isn't complete by the end of its section's first chunk is no title.
            title = None
            yield chunk(at)
            no += 1
            places = [] if opens or not overlap else places[-overlap:]
            own = len(places)
        if opens:
            level, by_marks, title = opens, marks, ""
            titles = [t for t in titles if t[0] < level]
        elif title is not None:
            if not by_marks and _closing.match(unit):
                titles, title = [*titles, (level, " ".join(_tag.sub(" ", title).split()))], None
            else:
                title += unit
        if title is not None and by_marks and not opens and "\n" in unit:
            titles, title = [*titles, (level, " ".join(title.split()))], None
        elif title is not None and by_marks and opens and "\n" in unit:
            title = None
        places.append(at)
    if len(places) > own:
        # A line of marks may end with the text.
        if title and by_marks:
            titles = [*titles, (level, " ".join(title.split()))]
        yield chunk(len(text))


def chunks(df: DataFrame, text: str, keep: list[str], name: str = "chunk", budget: int = BUDGET, overlap: int = OVERLAP) -> DataFrame:
    """The columns `keep` and a struct `name` for each chunk: no (from 0), start (of its own part, in characters from 0), lead (characters
    repeated from before `start`), units (repeated ones included, `budget` at most), heading (titles above it, outermost first) and text.

    Null and empty texts have no chunks. Rows with equal texts are cut each on its own.
    """
    require_columns(df, [*keep, text])
    if name.lower() in {k.lower() for k in keep}:
        raise InvalidInput(f"there is a column {name} already")
    if not 0 <= 2 * overlap <= budget or budget < 1:
        raise InvalidInput("the overlap can be half of the budget at most")
    source = df.select(*dict.fromkeys([*keep, text]))
    index, kept = source.columns.index(text), [source.columns.index(k) for k in keep]

    def run(batches):
        arrow = pa.struct([("no", pa.int32()), ("start", pa.int64()), ("lead", pa.int64()), ("units", pa.int32()), ("heading", pa.string()), ("text", pa.string())])

        def made(batch, rows, found):
            structs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], fields=list(arrow))
            return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows, pa.int32())) for i in kept), structs], names=[*keep, name])

        for batch in batches:
            rows, found, size = [], [], 0
            for row in range(batch.num_rows):
                for one in cut(batch.column(index)[row].as_py() or "", budget, overlap):
                    rows.append(row)
                    found.append(one)
                    size += len(one[-1])
                    if size > _BATCH:
                        yield made(batch, rows, found)
                        rows, found, size = [], [], 0
            if rows:
                yield made(batch, rows, found)

    return source.mapInArrow(run, T.StructType([*(source.schema[k] for k in keep), T.StructField(name, CHUNK)]))
