"""The role of a book's section, from its heading and the start of its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

#: Signs of a role, first match wins.
ROLE_SIGNS = (
    ("dramatis", ("dramatis", "действующ")),
    ("vessels", ("vessels", "корабл")),
    ("legend", ("41st millennium", "десять тысяч лет", "it is the 41st")),
    ("epilogue", ("epilogue", "эпилог")),
    ("appendix", ("appendix", "приложен")),
    ("author", ("about the author", "об авторе")),
)
#: Number words.
ONE_TO_NINETEEN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40}
RUSSIAN = {
    "первая": 1, "вторая": 2, "третья": 3, "четвёртая": 4, "четвертая": 4, "пятая": 5, "шестая": 6, "седьмая": 7,
    "восьмая": 8, "девятая": 9, "десятая": 10, "одиннадцатая": 11, "двенадцатая": 12, "тринадцатая": 13,
    "четырнадцатая": 14, "пятнадцатая": 15, "шестнадцатая": 16, "семнадцатая": 17, "восемнадцатая": 18,
    "девятнадцатая": 19, "двадцатая": 20, "тридцатая": 30, "сороковая": 40,
}
RUSSIAN_TENS = {"двадцать": 20, "тридцать": 30}
#: Characters of text looked at, and the highest chapter number.
WINDOW, HIGHEST = 400, 40


def number_words() -> dict[str, int]:
    """Every number word and compound up to forty."""
    words = {w: n for n, w in enumerate(ONE_TO_NINETEEN, 1)} | TENS | RUSSIAN
    for ten, units in ((TENS, dict(zip(ONE_TO_NINETEEN[:9], range(1, 10)))), (RUSSIAN_TENS, {w: n for w, n in RUSSIAN.items() if n < 10})):
        words |= {f"{t} {u}": a + b for t, a in ten.items() if a < HIGHEST for u, b in units.items()}
    return words


def chapter_number(text: Column) -> Column:
    """The number after the first ``chapter`` (or its Russian word) that has one, else null.

    One or two leading digits count if they are 1 to 40; otherwise the longest number
    word that is not followed by a letter, hyphens being blanks.
    """
    words = number_words()
    table = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    longest = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    after = F.regexp_extract_all(text, F.lit(r"(?iud)(?:chapter|глава)[\s\u00A0\u2000-\u200A\u3000]+(.{1,40})"), 1)

    def number(rest: Column) -> Column:
        rest = F.translate(trim_space(rest), "-", " ")
        digits = F.regexp_extract(rest, "^[0-9]{1,2}", 0)
        value = F.when(digits != "", digits.cast("int"))
        word = F.lower(F.regexp_extract(rest, rf"(?iu)^({longest})(?!\p{{L}})", 1))
        return F.when(value.between(1, HIGHEST), value).when(word != "", F.try_element_at(table, word))

    found = F.filter(F.transform(after, number), lambda n: n.isNotNull())
    return F.try_element_at(found, F.lit(1))


def classify_role(heading: Column, text: Column) -> Column:
    """dramatis, vessels, legend, epilogue, appendix, author, ``chapter N`` or other."""
    title, start = F.coalesce(heading, F.lit("")), F.left(F.coalesce(text, F.lit("")), F.lit(WINDOW))
    hay = F.when(title == "", start).otherwise(F.concat(title, F.lit("\n"), start))
    low = F.lower(hay)
    role = None
    for name, signs in ROLE_SIGNS:
        test = F.lit(False)
        for sign in signs:
            test = test | F.contains(low, F.lit(sign))
        role = F.when(test, name) if role is None else role.when(test, name)
    number = chapter_number(hay)
    return role.when(number.isNotNull(), F.concat(F.lit("chapter "), number.cast("string"))).otherwise(F.lit("other"))
