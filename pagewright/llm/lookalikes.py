"""Letters of other scripts that look like Latin, Cyrillic or Greek ones. Fixed values, by host script."""

from __future__ import annotations

import unicodedata

#: Letters that look like a Latin letter, by that letter.
TO_LATIN = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һ", "i": "іıι", "j": "јϳ", "k": "κк", "l": "ӏ", "n": "ոп", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υսц", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Ꮮ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
#: Letters that look like a Cyrillic letter of the common alphabets.
TO_CYRILLIC = {
    "а": "aɑα", "с": "cϲ", "е": "e", "һ": "h", "і": "iι", "ј": "j", "о": "oοօ", "р": "pρ", "ѕ": "s", "х": "xχ", "у": "y", "к": "κ", "п": "ո", "г": "r", "в": "ʙ", "н": "ʜ", "т": "τ", "м": "ʍ", "ё": "ë", "ї": "ï",
    "А": "AΑ", "В": "BΒ", "С": "CϹ", "Е": "EΕ", "Н": "HΗ", "І": "IΙ", "Ј": "J", "К": "KΚ", "М": "MΜ", "О": "OΟՕ", "Р": "PΡ", "Ѕ": "S", "Т": "TΤ", "Х": "XΧ", "У": "Y", "Г": "Γ", "П": "Π", "Ф": "Φ", "Ё": "Ë", "Ї": "Ï",
}
#: Letters that look like a Greek letter.
TO_GREEK = {
    "ο": "oоօ", "ν": "vѵ", "ρ": "pр", "α": "aаɑ", "ι": "iіı", "κ": "kк", "υ": "uս", "χ": "xх", "γ": "yу", "ω": "w", "τ": "т", "η": "n", "ε": "ɛ", "ό": "ó", "ά": "á", "ί": "í", "ύ": "ú",
    "Α": "AА", "Β": "BВ", "Ε": "EЕ", "Ζ": "Z", "Η": "HН", "Ι": "IІ", "Κ": "KК", "Μ": "MМ", "Ν": "N", "Ο": "OОՕ", "Ρ": "PР", "Τ": "TТ", "Υ": "YУ", "Χ": "XХ", "Γ": "Г", "Π": "П", "Φ": "Ф",
}

LATIN, CYRILLIC, GREEK, ARMENIAN = "LATIN", "CYRILLIC", "GREEK", "ARMENIAN"
HOSTS = {host: {look: letter for letter, looks in table.items() for look in looks} for host, table in ((LATIN, TO_LATIN), (CYRILLIC, TO_CYRILLIC), (GREEK, TO_GREEK))}
#: Letters of the host's own script that stand for another of its letters.
ALIEN_IN_HOST = {LATIN: frozenset("ɑɡı"), CYRILLIC: frozenset(), GREEK: frozenset("ϲϹ")}


def script(c: str) -> str | None:
    """LATIN, CYRILLIC, GREEK, ARMENIAN or OTHER for letters, else None."""
    if c.isascii():
        return LATIN if c.isalpha() else None
    if not c.isalpha():
        return None
    o = ord(c)
    if 0x00AA <= o <= 0x02AF or 0x1E00 <= o <= 0x1EFF:
        return LATIN
    if 0x0400 <= o <= 0x052F:
        return CYRILLIC
    if 0x0370 <= o <= 0x03FF or 0x1F00 <= o <= 0x1FFF:
        return GREEK
    if 0x0530 <= o <= 0x058F:
        return ARMENIAN
    name = unicodedata.name(c, "")
    return LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else "OTHER"
