"""Column functions for names, labels, templates and paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display-name templates by label.
NAME_TEMPLATES = {
    "Order": "주문 #{id} ({status})",
    "Payment": "결제 #{id} ({method})",
    "Review": "리뷰 #{id} ({rating}점)",
    "Address": "{city} {district}",
    "Shipping": "배송 #{id} ({status})",
    "Coupon": "{code} ({discount_pct}%)",
}
NAME_CANDIDATES = ("name", "title", "code")
NAME_EXTRAS = ("status", "type", "method", "category")

# Stopwords of the keyword reranker.
STOPWORDS_KO = (
    "은 는 이 가 을 를 의 에 에서 로 으로 와 과 도 만 까지 부터 에게 한테".split()
)
STOPWORDS_EN = (
    "the a an is are was were in on at to for of with and or but not this that it".split()
)


def blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def pascal_label(col: Column) -> Column:
    """``order_items`` -> ``OrderItems``."""
    return F.regexp_replace(F.initcap(F.regexp_replace(col, "_", " ")), " ", "")


def relation_name(col: Column) -> Column:
    """``customer_id`` -> ``CUSTOMER``."""
    return F.upper(F.regexp_replace(col, "_id$", ""))


def singular(col: Column) -> Column:
    """Naive English singular with length guards."""
    w = F.lower(col)
    n = F.length(w)
    return (
        F.when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
        .when(w.endswith("es") & (n > 3), F.left(w, n - 2))
        .when(w.endswith("s") & (n > 2), F.left(w, n - 1))
        .otherwise(w)
    )


def synonyms(col: Column, table: Mapping[str, Sequence[str]]) -> Column:
    """Apply every replacement in order, case-insensitively and literally."""
    out = col
    for canonical, words in table.items():
        for word in words:
            literal = canonical.replace("\\", "\\\\").replace("$", "\\$")  # no group references
            out = F.regexp_replace(out, r"(?iu)\Q" + word + r"\E", literal)
    return out


def has_hangul(col: Column) -> Column:
    return col.rlike("[가-힣]")


def keywords(col: Column) -> Column:
    """Distinct lower-cased words longer than one character, without stopwords."""
    tokens = F.transform(F.regexp_extract_all(col, F.lit(r"(?U)([\w가-힣]+)"), 1), F.lower)
    stop = F.when(has_hangul(col), F.array(*map(F.lit, STOPWORDS_KO))).otherwise(
        F.array(*map(F.lit, STOPWORDS_EN))
    )
    return F.array_except(F.filter(tokens, lambda t: F.length(t) > 1), stop)


def preview(col: Column, n: int) -> Column:
    return F.left(col, F.lit(n))


def json_digest(*cols: Column) -> Column:
    """SHA-256 of a canonical JSON object; fields in the given order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def path_template(col: Column) -> Column:
    """Replace all-digit path segments; drop trailing slashes; empty -> ``/``."""
    parts = F.split(F.regexp_replace(col, "/+$", ""), "/")
    joined = F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), "{id}").otherwise(p)), "/"
    )
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def render(template: str, value_of: Callable[[str], Column | None]) -> Column:
    """``"{a} #{b}"`` -> concatenation; absent or null values render as ''."""
    pieces = []
    for literal, name in re.findall(r"([^{}]*)(?:\{([^{}]*)\})?", template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            value = value_of(name)
            if value is not None:
                pieces.append(F.coalesce(value.cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def grouped_number(col: Column) -> Column:
    """Thousands separators, no decimals."""
    return F.format_number(col, 0)


def name_template(label: str, props: Sequence[str]) -> str:
    """Template for a label: known, then a naming property, then id plus a qualifier."""
    if label in NAME_TEMPLATES:
        return NAME_TEMPLATES[label]
    for candidate in NAME_CANDIDATES:
        if candidate in props:
            return "{" + candidate + "}"
    for extra in NAME_EXTRAS:
        if extra in props:
            return label + " #{id} ({" + extra + "})"
    return label + " #{id}"


def display_name(value_of: Callable[[str], Column], label: str, key: Column) -> Column:
    """Readable name of a node: a naming property, a rule of its label, or ``Label #id``."""

    def text(prop: str) -> Column:
        return F.coalesce(value_of(prop).cast("string"), F.lit(""))

    def shortened(col: Column, n: int) -> Column:
        return F.concat(F.left(col, F.lit(n)), F.when(F.length(col) > n, F.lit("…")).otherwise(""))

    key_text = F.coalesce(value_of("id").cast("string"), key.cast("string"))
    rules: list[tuple[Column, Column]] = [
        (~blank(value_of(p).cast("string")), value_of(p).cast("string")) for p in ("name", "code", "title")
    ]
    if label == "JournalEntry":
        number, note = text("entry_number"), text("description")
        rules += [
            ((number != "") & (note != ""), F.concat(number, F.lit(": "), shortened(note, 20))),
            (number != "", number),
            (note != "", F.left(note, F.lit(30))),
        ]
    elif label == "JournalLine":
        rules.append((text("description") != "", shortened(text("description"), 30)))
    elif label == "Invoice":
        number, status = text("invoice_number"), text("status")
        rules += [
            ((number != "") & (status != ""), F.concat(number, F.lit(" ("), status, F.lit(")"))),
            (number != "", number),
        ]
    elif label == "FiscalPeriod":
        year, month, quarter = text("year"), text("month"), text("quarter")
        tail = F.when(quarter != "", F.concat(F.lit(" (Q"), quarter, F.lit(")"))).otherwise("")
        rules.append(
            ((year != "") & (month != ""), F.concat(year, F.lit("-"), F.lpad(month, 2, "0"), tail))
        )
    elif label == "Budget":
        amount = value_of("budget_amount").try_cast("double")
        rules.append(
            (amount.isNotNull(), F.concat(F.lit("예산 #"), key_text, F.lit(" ("), grouped_number(amount), F.lit(")")))
        )
    elif label == "Payment":
        rules.append(
            (text("method") != "", F.concat(F.lit("결제 #"), key_text, F.lit(" ("), text("method"), F.lit(")")))
        )
    out = F.when(*rules[0])
    for condition, value in rules[1:]:
        out = out.when(condition, value)
    return out.otherwise(F.concat(F.lit(f"{label} #"), key_text))
