"""Text columns: tidying, names of suppliers and people, product words."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that say a counterparty record must not be used, longest first.
UNWANTED_PHRASES = [
    "не использовать дубль",
    "Не использовать дубль",
    "<не использовать>",
    "не использовать",
    "Не использовать",
    "[Удалено]",
]

# Canonical counterparty name and its known spellings.
SUPPLIER_ALIASES = {
    "GE Nuovo Pignone": [
        "Nuovo Pignone / GE Oil & Gas (Italy)",
        "Nuovo Pignone International S.r.l. (BHGE)",
        "BAKER HUGHES NUOVO PIGNONE INTERNATIONAL SRL",
    ],
    'СП "Ташкент трубный завод"': [
        "Не использовать V L GALPERIN NOMIDAGI TOSHKENT TRUBA ZAVODI СП ООО",
        '[Удалено]СП "Ташкентский трубный завод"',
        'СП "Ташкентский трубный завод"',
        "V L GALPERIN NOMIDAGI TOSHKENT TRUBA ZAVODI СП ООО",
    ],
    "ООО ТСК-РЕГИОН": ["ТСК-РЕГИОН ООО", "ТСК РЕГИОН", "ТСК Регион "],
    "ООО УПСК-экспорт": ["УПСК-ЭКСПОРТ ООО", "не использовать УПСК-экспорт ООО", "ООО «УПСК-экспорт»"],
    "М5-ЭКСПОРТ ООО": [
        '[Удалено]ООО"М5Group"',
        "М5-ЭКСПОРТ ООО",
        "не использовать дубль М5 ГРУПП",
        "М5 ГРУПП ООО",
    ],
    'ООО "Темир Бетон': ['ООО "Темир Бетон Конструкциялари Комбинати"'],
    "DREAM ALLIANCE": ["не использовать DREAM-ALLIANCE"],
    "NEW FORMAT TASHKENT": ["не использовать NEW FORMAT TASHKENT"],
    "NASIBA GAVHAR": ["не использовать NASIBA GAVHAR"],
    "Daromad Munira Fayz": ["Daromad Munira Fayz Textile<не использовать>"],
    "СП OOO AZIA METAL PROF": ["СП ОБЩЕСТВО С ОГРАНИЧЕННОЙ ОТВЕТСТВЕННОСТЬЮ AZIA METALL PROF"],
    "ООО ОМСКИЙ ЗАВОД ТРУБ АРМАТ": ["ТОРГОВЫЙ ДОМ ОМСКИЙ ЗАВОД ТРУБОПРОВОДНОЙ АРМАТУРЫ ООО"],
    "ООО ОМСКИЙ ЗАВОД ЗАПОРН АРМАТ": ["ОМСКИЙ ЗАВОД ЗАПОРНОЙ АРМАТУРЫ ООО"],
    "Омский з-д запорн армат": ["ООО «Омский завод запорной арматуры»", "ООО ОМСКИЙ ЗАВОД ЗАПОРН АРМАТ"],
    "SBW ELECTRO-MECH IMP AND EXP CO": ["Не использовать SBW ELECTRO-MECHANICS IMPORT AND EXPORT CO"],
    "ООО «Челябинский компрессорный завод»": ["[Удалено] ООО «Челябинск компрессор завод»"],
    "OOO GAMMA COLOR SERVICE": ["GAMMA COLOR SERVICE ООО"],
    "BAGRAIN TOO": ["БАГРАЙН ТОО", "BAGRAIN TECHNOCOLOR ТОО"],
    "CERAMIC BRIKS OOO": ['СП ООО "CERAMIC BRICKS"', "не использовать CERAMIC BRICKS"],
    "POINT VISION СП ООО": ["не использовать дубль Point Vision ПИИ", "Point Vision ПИИ"],
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_line(c: Column | str) -> Column:
    """Line breaks become spaces, outer spaces go."""
    return F.trim(F.regexp_replace(_col(c), "\n", " "))


def before_bracket(c: Column | str) -> Column:
    """Name up to the first bracket: ``Иванов (отдел)`` -> ``Иванов``."""
    return F.trim(F.substring_index(_col(c), "(", 1))


def without_unwanted_phrases(c: Column | str) -> Column:
    """Supplier name without "do not use" marks, inner spaces collapsed."""
    name = _col(c)
    for phrase in UNWANTED_PHRASES:
        name = F.replace(name, F.lit(phrase), F.lit(""))
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def canonical_supplier(c: Column | str, aliases: dict[str, list[str]] | None = None) -> Column:
    """Canonical supplier name: alias of the raw name, then of the cleaned one, else the cleaned name."""
    raw = _col(c)
    cleaned = without_unwanted_phrases(raw)
    pairs = [(a, main) for main, names in (aliases or SUPPLIER_ALIASES).items() for a in names]
    lookup = F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs)))
    return F.coalesce(lookup[raw], lookup[cleaned], cleaned)


def first_word(c: Column | str) -> Column:
    return F.split(_col(c), " ")[0]


def product_type(c: Column | str) -> Column:
    """First word of the product name, capitalised."""
    return F.initcap(first_word(c))


def safe_name(c: Column | str, length: int = 31) -> Column:
    """A name fit for a file or a sheet: forbidden characters become ``_``, cut to ``length``."""
    return F.substring(F.regexp_replace(_col(c), r'[\\/*?:"<>|\[\]]', "_"), 1, length)


def thousands(c: Column | str, digits: int = 2) -> Column:
    """Number as text with a space between thousands and a comma before decimals."""
    text = F.format_number(_col(c), digits)
    return F.translate(text, ",.", " ,")


def normalised_product(c: Column | str) -> Column:
    """Lower case, single spaces, look-alike letters mapped to one spelling."""
    squeezed = F.regexp_replace(F.lower(_col(c)), r"\s+", " ")
    return F.trim(F.translate(squeezed, "øф∅х×ё", "ofoxxе"))


def match_text(c: Column | str) -> Column:
    """Text form compared by the name matcher: points dropped, commas become points."""
    squeezed = F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))
    return F.translate(F.translate(squeezed, ".", ""), ",", ".")


def shortened(c: Column | str, length: int) -> Column:
    return F.when(F.length(_col(c)) > length, F.concat(F.substring(_col(c), 1, length), F.lit("..."))).otherwise(
        _col(c)
    )


def joined(array: Column | str, separator: str = ", ") -> Column:
    return F.array_join(F.sort_array(_col(array)), separator)
