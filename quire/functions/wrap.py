"""Greedy word wrap by glyph advances, of columns and for drawn covers, and the layout of these as SVG.

``with_lines`` works on columns of any text inside the JVM: sizes of words, the word that each line starts with by one fold over
them, then slices of the words. The fold goes in chunks, so that what it copies as it grows stays small, however long a text
is. The fonts of a drawn cover are the reader's own (SVG text, centred), as no font files are at hand; advances are then
those of a table that callers give, or of ``estimate``.
"""

from __future__ import annotations

from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of a drawn cover: pixels and colours.
WIDTH, HEIGHT, LARGEST, SMALLEST, STEP, AUTHOR, LEADING, MOST_LINES = 1600, 2560, 140, 40, 8, 72, 1.3, 5
GROUND, TITLE_INK, AUTHOR_INK = "#1c2433", "#f5f7fa", "#a8b6cc"


#: Items that the inner fold of line starts takes at a time, at least.
CHUNK = 64


def line_starts(sizes: Column, most: int, gap: int) -> Column:
    """Positions (from 0) of the items that lines start with, each of as many as fit into ``most``, ``gap`` between two.

    ``sizes`` (longs, none negative) are read once a chunk, so they are to be a column, not an expression. A fold copies its
    state at each step, so a chunk has about as many items as there are chunks.
    """
    many = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(F.size(sizes))).cast("int"))
    state = lambda k, room, starts: F.struct(k.alias("k"), room.alias("room"), starts.alias("starts"))
    none = F.array().cast("array<int>")

    def item(s: Column, size: Column) -> Column:
        # One condition for all of the state: each step of a fold is interpreted. ``room`` is what a further item may take.
        fits = state(s["k"] + 1, s["room"] - size - gap, s["starts"])
        return F.when(size <= s["room"], fits).otherwise(state(s["k"] + 1, F.lit(most - gap).cast("long") - size, F.concat(s["starts"], F.array(s["k"]))))

    def chunk(s: Column, at: Column) -> Column:
        # The inner fold's result is taken apart in its last step, as an expression would run it for each part.
        joined = lambda f: F.struct(f["k"].alias("k"), f["room"].alias("room"), F.concat(s["starts"], F.array(f["starts"])).alias("starts"))
        return F.reduce(F.slice(sizes, at + 1, many), state(s["k"], s["room"], none), item, joined)

    start = F.struct(F.lit(0).alias("k"), F.lit(-1).cast("long").alias("room"), F.array().cast("array<array<int>>").alias("starts"))
    chunks = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1, many)).otherwise(none)
    return F.reduce(chunks, start, chunk, lambda s: F.flatten(s["starts"]))


def word_pieces(word: Column, most: int, width: Callable[[Column], Column]) -> Column:
    """The word in the widest pieces that fit, of one character at least."""
    state = lambda done, piece, room: F.struct(done.alias("done"), piece.alias("piece"), room.alias("room"))

    def character(s: Column, c: Column) -> Column:
        size = width(c).cast("long")
        closed = (s["piece"] != "") & (size > s["room"])
        done = F.when(closed, F.concat(s["done"], F.array(s["piece"]))).otherwise(s["done"])
        return state(done, F.when(closed, c).otherwise(F.concat(s["piece"], c)), F.when(closed, F.lit(most).cast("long")).otherwise(s["room"]) - size)

    start = state(F.array().cast("array<string>"), F.lit(""), F.lit(most).cast("long"))
    return F.reduce(F.split(word, ""), start, character, lambda s: F.concat(s["done"], F.array(s["piece"])))


def with_lines(frame: DataFrame, text: str, name: str, most: int, width: Callable[[Column], Column], space: int) -> DataFrame:
    """``frame`` with the lines of ``text`` as an array ``name``: white space collapsed, whole words where they fit, the widest
    pieces of others.

    ``width`` gives the whole number of units of a string, the sum of its characters'; null text has no lines.
    """
    words, sizes, starts = (f"{name}_{k}" for k in ("words", "sizes", "starts"))
    size = lambda w: width(w).cast("long")
    wide = F.exists(sizes, lambda s: s > most)
    pieces = F.flatten(F.transform(words, lambda w: F.when(size(w) > most, word_pieces(w, most, width)).otherwise(F.array(w))))
    out = frame.withColumn(words, F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), ""))
    # Sizes are a column, as the fold over them would make them anew for each chunk; few texts have words to break.
    out = out.withColumn(sizes, F.transform(words, size)).withColumn(words, F.when(wide, pieces).otherwise(F.col(words)))
    out = out.withColumn(sizes, F.when(wide, F.transform(words, size)).otherwise(F.col(sizes))).withColumn(starts, line_starts(F.col(sizes), most, space))
    end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(words))
    return out.withColumn(name, F.transform(starts, lambda at, i: F.array_join(F.slice(words, at + 1, end(i) - at), " "))).drop(words, sizes, starts)


def estimate(c: str) -> float:
    """Advance of a character in ems, for common sans-serif faces."""
    return 0.28 if c in "iljI.,;:'|! " else 0.9 if c in "mwMW@" else 0.7 if c.isupper() else 0.56


def text_width(text: str, advance: Callable[[str], float]) -> float:
    return sum(map(advance, text))


def broken(word: str, most: float, advance: Callable[[str], float]) -> list[str]:
    """The word, or the widest pieces of it that fit (of one character at least)."""
    pieces, room = [""], most
    for c in word:
        if pieces[-1] and advance(c) > room + 1e-9:
            pieces.append("")
            room = most
        pieces[-1] += c
        room -= advance(c)
    return pieces


def wrap_text(text: str, most: float, advance: Callable[[str], float]) -> list[str]:
    """Lines of at most ``most``: whole words where they fit, white space collapsed."""
    lines: list[str] = []
    room = 0.0
    for word in text.split():
        for piece in broken(word, most, advance):
            width = text_width(piece, advance)
            if lines and advance(" ") + width <= room + 1e-9:
                lines[-1] += " " + piece
                room -= advance(" ") + width
            else:
                lines.append(piece)
                room = most - width
    return lines


def drawn_cover(title: str, author: str, advance: Callable[[str], float] = estimate) -> str:
    """An SVG cover: the title in at most five lines if it can be, the author below."""
    margin = WIDTH // 8
    column, size = WIDTH - 2 * margin, LARGEST
    while True:
        lines = wrap_text(title, column / size, advance)
        fits = all(text_width(w, advance) * size <= column for w in title.split())
        if size <= SMALLEST or (len(lines) <= MOST_LINES and fits):
            break
        size -= STEP
    names = wrap_text(author, column / AUTHOR, advance)
    step, name_step = size * LEADING, AUTHOR * LEADING
    gap = step if names else 0.0
    y = max((HEIGHT - len(lines) * step - gap - len(names) * name_step) / 2 * 0.85, margin)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}"><rect width="{WIDTH}" height="{HEIGHT}" fill="{GROUND}"/>']
    for parts, ink, font, height, weight, after in ((lines, TITLE_INK, size, step, "bold", gap), (names, AUTHOR_INK, AUTHOR, name_step, "normal", 0.0)):
        for part in parts:
            out.append(f'<text x="{WIDTH // 2}" y="{y + font:.1f}" font-family="sans-serif" font-weight="{weight}" font-size="{font}" fill="{ink}" text-anchor="middle">{escape(part)}</text>')
            y += height
        y += after
    return "".join(out) + "</svg>"
