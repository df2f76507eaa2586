"""Names of columns: readable, normalized, and what they say about privacy. Plain Python: names are metadata."""

from __future__ import annotations

import re
import unicodedata


def plain(text: str) -> str:
    """Squeezed, lower case, without accents."""
    return unaccented(" ".join(text.split()).lower())


def unaccented(text: str) -> str:
    """Without accents, if all characters are of ranges in which they are marks on letters."""
    if not all(ord(c) <= 0x52F or 0x1E00 <= ord(c) <= 0x2BFF for c in text):
        return text
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c)[0] != "M"))


def normalized_names(names: list[str]) -> list[str]:
    """Lower case, without accents; spaces and dashes are an underscore, none at the end, other signs go; a leading digit gets col_, nothing at all is unnamed; repeats are numbered from _2."""
    taken: set[str] = set()
    out = []
    for name in names:
        base = re.sub(r"[\s-]+", "_", re.sub(r"[\s-]+$", "", re.sub(r"[^\w\s-]", "", unaccented(name).lower())))
        base = f"col_{base}" if base[:1].isdigit() else base or "unnamed"
        found, k = base, 2
        while found in taken:
            found, k = f"{base}_{k}", k + 1
        taken.add(found)
        out.append(found)
    return out


def readable_headers(names: list[str | None]) -> list[str]:
    """Empty headers are column_N; repeats are numbered from _2."""
    taken: set[str] = set()
    out = []
    for i, name in enumerate(names, 1):
        base = (name or "").strip() or f"column_{i}"
        found, k = base, 2
        while found in taken:
            found, k = f"{base}_{k}", k + 1
        taken.add(found)
        out.append(found)
    return out


#: What in a name tells of which kind of personal data; text anywhere in the name, tokens as whole words only.
EMAIL_TEXT, EMAIL_TOKENS = ["email", "correo"], ["mail"]
PHONE_TEXT, PHONE_TOKENS = ["phone", "telefono", "movil", "celular"], ["tel"]
ADDRESS_TEXT = ["address", "direccion", "domicilio"]
IDENTIFIER_TOKENS = ["id", "uuid", "identifier", "identificador", "codigo", "code", "clave", "key", "dni", "cedula", "pasaporte", "passport", "ssn"]
NAME_TEXT, NAME_TOKENS = ["nombre", "apellido", "surname"], ["name"]
#: Words beside "name" that make it the name of a thing.
THING_TOKENS = [
    "file", "host", "sheet", "table", "column", "field", "path", "domain", "server", "schema", "type", "class", "db", "database", "product",
    "item", "category", "brand", "company", "store", "city", "country", "region", "dataset", "project", "app",
]


def privacy_signal(name: str) -> str | None:
    """email, phone, address, identifier, name or None."""
    tokens = [t for t in re.split(r"[\W_]+", plain(re.sub(r"(?<=[^\W_A-Z])(?=[A-ZÁÉÍÓÚÑÜ])", " ", name))) if t]
    whole = "".join(tokens)

    def says(text: list[str], words: list[str]) -> bool:
        return any(t in whole for t in text) or any(t in words for t in tokens)

    if says(EMAIL_TEXT, EMAIL_TOKENS):
        return "email"
    if says(PHONE_TEXT, PHONE_TOKENS):
        return "phone"
    if says(ADDRESS_TEXT, []):
        return "address"
    if says([], IDENTIFIER_TOKENS):
        return "identifier"
    if says(NAME_TEXT, []) or (says([], NAME_TOKENS) and not says([], THING_TOKENS)):
        return "name"
    return None


#: Signals of which the values are personal; an identifier's are not by themselves.
PERSONAL = ("email", "phone", "address", "name")
