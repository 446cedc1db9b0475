"""String functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words, as a character class that Java and RE2 both take.
WHITE_SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: Stands for a symbol that has no text of its own; a word that holds it is not compared.
UNCOMPARABLE = "\x00"
#: Suffix of a file by MIME type.
SUFFIXES = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tif", "image/svg+xml": ".svg", "image/webp": ".webp", "audio/mpeg": ".mp3", "audio/wav": ".wav", "video/mp4": ".mp4", "application/pdf": ".pdf"}
#: Media types that a browser draws.
DRAWABLE = ("image/png", "image/jpeg", "image/gif")


def normalised(text: Column) -> Column:
    """Typographic hyphens as ``-``, soft hyphens gone."""
    return F.translate(F.coalesce(text, F.lit("")), "‐‑­", "--")


def tokens(text: Column) -> Column:
    """Words between white space, case and punctuation kept; words with the uncomparable mark left out."""
    return F.filter(F.split(normalised(text), WHITE_SPACE), lambda w: (w != "") & ~F.contains(w, F.lit(UNCOMPARABLE)))


def folded(text: Column) -> Column:
    """Lower case, with the one expansion that matters in names: ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def family_key(name: Column) -> Column:
    """A font family's key: quotes and outer blanks gone, inner blanks squeezed, case folded."""
    bare = F.regexp_replace(F.trim(name), "^[\"']+|[\"']+$", "")
    return folded(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def list_head(name: Column) -> Column:
    """The first item of a comma-separated list."""
    return F.trim(F.split(name, ",")[0])


def base_name(path: Column) -> Column:
    """The last part of a path, whichever slashes it has."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def file_key(path: Column) -> Column:
    return folded(F.trim(base_name(path)))


def extension(name: Column) -> Column:
    """The last suffix in lower case, empty if none."""
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def suffix_of_mime(mime: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.lower(mime)], F.lit(".bin"))


def clean_file_name(name: Column, most: int = 80) -> Column:
    """Without characters that file systems refuse, blanks squeezed, at most so long."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f\x7f<>:"/\\|?*]', " "), r"\s+", " ")), F.lit(most))


def printable(text: Column) -> Column:
    """Without control characters and object marks; tabs and line breaks stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{fffc}]", "")


def object_id(prefix: str, name: Column, most: int = 50) -> Column:
    return F.left(F.concat(F.lit(prefix), F.regexp_replace(name, r"[^A-Za-z0-9_:\-]", "_")), F.lit(most))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def column_letters(number: Column, most: int = 4) -> Column:
    """A spreadsheet column's letters: 1 is A, 27 is AA. Up to ``most`` letters."""
    out, rest = F.lit(""), number.cast("long")
    for _ in range(most):
        digit = F.pmod(rest - 1, F.lit(26))
        out = F.when(rest > 0, F.concat(F.char(digit + 65), out)).otherwise(out)
        rest = F.when(rest > 0, ((rest - 1 - digit) / 26).cast("long")).otherwise(rest)
    return out


def reference_column(ref: Column) -> Column:
    """Column number of a reference such as AB12; null if it isn't one."""
    letters = F.regexp_extract(ref, r"\A([A-Z]{1,4})([1-9][0-9]*)\z", 1)
    value = F.aggregate(F.split(letters, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(a * 26 + F.ascii(c) - 64))
    return F.when(letters != "", value)


def reference_row(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"\A([A-Z]{1,4})([1-9][0-9]*)\z", 2)
    return F.when(digits != "", digits.try_cast("int"))


def range_corner(ref: Column) -> Column:
    """The far corner of a range, or the reference itself: a struct of row and col, (0, 0) if it isn't one."""
    far = F.element_at(F.split(ref, ":"), -1)
    return F.struct(F.coalesce(reference_row(far), F.lit(0)).alias("row"), F.coalesce(reference_column(far), F.lit(0)).alias("col"))


TEXT_DATE = r"\A\s*\d{1,2}([/.\-])\d{1,2}[/.\-](\d{2}|\d{4})\s*\z"
DATE_INSIDE = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{4}|\d{2})\b"


def is_text_date(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(TEXT_DATE)), F.lit(False))


def without_markup(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags taken out, blanks squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def label_starts_with_word(label: Column, word: Column) -> Column:
    """Whether a label is a word, or begins with it as a whole word."""
    return (folded(label) == folded(word)) | F.startswith(folded(label), F.concat(folded(word), F.lit(" ")))


def seconds_of(text: Column) -> Column:
    """Seconds of a start mark such as 1h2m3s, 90s or 90."""
    part = lambda unit: F.coalesce(F.regexp_extract(text, rf"(\d+){unit}", 1).try_cast("int"), F.lit(0))
    return F.when(F.rlike(text, F.lit(r"\A\d+\z")), text.try_cast("int")).when(F.rlike(text, F.lit(r"\A(\d+h)?(\d+m)?(\d+s)?\z")) & (text != ""), part("h") * 3600 + part("m") * 60 + part("s"))


def video_provider(url: Column) -> Column:
    """Struct of provider, id and start second of a link to an online video; null provider if it is none."""
    host = F.lower(F.regexp_extract(url, r"(?i)\Ahttps?://(?:www\.|m\.)?([^/:?#]+)", 1))
    path = F.regexp_extract(url, r"(?i)\Ahttps?://[^/?#]+(/[^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    own = lambda name: F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    ident = F.when(host == "youtu.be", F.regexp_extract(path, r"\A/([\w\-]{11})", 1)).when(host.isin("youtube.com", "youtube-nocookie.com"), F.coalesce(F.nullif(F.regexp_extract(path, r"\A/(?:embed|shorts|live|v)/([\w\-]{11})", 1), F.lit("")), F.regexp_extract(own("v"), r"\A([\w\-]{11})\z", 1))).when(host.isin("vimeo.com", "player.vimeo.com"), F.regexp_extract(path, r"/(\d+)\z", 1))
    known = F.coalesce(ident, F.lit("")) != ""
    provider = F.when(known & host.isin("youtu.be", "youtube.com", "youtube-nocookie.com"), "youtube").when(known, "vimeo")
    return F.struct(provider.alias("provider"), F.when(known, ident).alias("id"), seconds_of(F.coalesce(F.nullif(own("t"), F.lit("")), own("start"))).alias("start"))


def listed(items: Column, most: int = 3) -> Column:
    """Up to ``most`` items in a row, else as many and how many more."""
    n = F.size(items)
    return F.when(n <= most, F.concat_ws(", ", items)).otherwise(F.concat(F.concat_ws(", ", F.slice(items, 1, most)), F.lit(" and "), (n - most).cast("string"), F.lit(" more")))


def zero_padded(number: Column, width: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(text), F.lit(0))), text)


def signed_link_masked(text: Column) -> Column:
    return F.regexp_replace(text, r"(https?://[^\s?]+)\?[^\s]*[Ss]ignature=[^\s]*", "$1?…")


def rfc3986(text: Column) -> Column:
    """Percent-encoding of everything but unreserved characters."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def rgb_of_bgr(value: Column) -> Column:
    """#rrggbb of a number whose low byte is red."""
    byte = lambda k: F.lpad(F.hex(F.shiftright(value, k).bitwiseAND(F.lit(255))), 2, "0")
    return F.lower(F.concat(F.lit("#"), byte(0), byte(8), byte(16)))


def joined_lines(source: Column) -> Column:
    """Lines that end in a continuation mark joined to the next."""
    return F.regexp_replace(source, r" _[ \t]*\r?\n[ \t]*", " ")
