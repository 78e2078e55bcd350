"""Column functions that turn markup into plain text, and question detectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates text nodes, and the entities that are unescaped.
HTML_ITEMS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]+>"
HTML_TAGS = r"<[^>]+>"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))

# The markdown substitutions, in order.
MARKDOWN_STEPS = (
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*{1,3}(.+?)\*{1,3}", "$1"),
    (r"_{1,3}(.+?)_{1,3}", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"),
    (r"```[\s\S]*?```", ""),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^>\s+", ""),
    (r"(?m)^[-*_]{3,}\s*$", ""),
    (r"\n{3,}", "\n\n"),
)


def strip(col: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(F.regexp_replace(col, r"^\s+", ""), r"\s+$", "")


# What ``\s`` stands for, and the line ends beyond it that ``$`` looks past.
BLANKS = " \t\n\x0b\f\r"
LINE_ENDS = ("\u0085", "\u2028", "\u2029")


def strip_column(name: str) -> Column:
    """``strip`` of a short stored column: its ends are read, no pattern is tried all over it.

    White space before one last line end of another kind goes as well, as it does there.
    """
    col = F.col(name)
    return F.when(F.right(col, F.lit(1)).isin(*LINE_ENDS), strip(col)).otherwise(F.btrim(col, F.lit(BLANKS)))


def has_text(col: Column) -> Column:
    """Whether ``strip`` leaves anything: read up to the first sign that is no white space."""
    return F.ltrim(col, F.lit(BLANKS)) != ""


def html_flat(col: Column) -> Column:
    """Tags become blanks, white space collapses; script bodies stay."""
    return strip(F.regexp_replace(F.regexp_replace(col, HTML_TAGS, " "), r"\s+", " "))


def html_text(col: Column) -> Column:
    """Text nodes on their own lines, without script, style and comments.

    Runs of tags are first turned into a marker each, so that no pattern has to
    repeat a group over a long run.
    """
    marked = F.regexp_replace(col, HTML_ITEMS, "\u0001")
    text = F.regexp_replace(marked, "\u0001+", "\n")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def markdown_text(col: Column) -> Column:
    for pattern, replacement in MARKDOWN_STEPS:
        col = F.regexp_replace(col, pattern.replace("(?m)", "(?md)"), replacement)
    return strip(col)


# ---- questions -----------------------------------------------------------------

# Intent patterns in order of priority.
INTENT_PATTERNS = {
    "dikw_trace": (r"(?i)DIKW", r"(전체|종합).*(분석|보고서|리포트)", r"(데이터부터|처음부터).*(분석|추적)"),
    "what_if": (
        r"(만약|만일)",
        r"(중단|제거|이탈|없어지면|빠지면|중지)",
        r"~?면\s*(어떻게|어떤|무슨)",
        r"(영향|리스크|위험).*있",
    ),
    "recommendation": (
        r"(추천|제안|권장)",
        r"어떤.*좋을까",
        r"뭘.*해야",
        r"(강화|개선|최적화).*해야",
        r"(주의|관리).*해야",
    ),
    "causal": (r"왜\s", r"(원인|이유|인과)", r"(영향.*미치|때문|덕분)", r"(상관관계|상관)"),
    "pattern": (
        r"(패턴|트렌드|경향|특징|분포|세그먼트|클러스터)",
        r"(자주|많이).*같이.*(구매|주문)",
        r"어떤.*(특징|차이|공통점)",
        r"(분석|인사이트|통찰)",
    ),
}
# Aggregate-question and depth patterns.
AGGREGATE_PATTERNS = (
    r"(?i)(가장|많이|top|순위|평균|총|합계|통계|전체)",
    r"(?i)(카테고리별|고객별|상품별|월별|주문별)",
    r"(?i)(몇\s*개|몇\s*명|몇\s*건)",
    r"(?i)(most|total|average|ranking|statistics|overall|how\s*many)",
    r"(?i)(by\s+category|by\s+customer|by\s+product|per\s+month)",
)
DEPTH_ONE = r"(직접\s*연결|1홉|직접적)"
DEPTH_THREE = r"(전체\s*구조|전체\s*관계|3홉|모든\s*연결)"


def matches_any(col: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | col.rlike(pattern)
    return out


def intent(col: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, patterns in INTENT_PATTERNS.items():
        out = out.when(matches_any(col, patterns), name)
    return out.otherwise("lookup")


def is_aggregate(col: Column) -> Column:
    return matches_any(col, AGGREGATE_PATTERNS)


def depth(col: Column, default: int = 2) -> Column:
    return F.when(col.rlike(DEPTH_ONE), 1).when(col.rlike(DEPTH_THREE), 3).otherwise(default)


# Question patterns in order.  (template, pattern, parameter groups);
# a parameter lists the groups that may hold it.
W = r"(\S+?)"
QUESTION_RULES = (
    ("custom_q2", W + r"(?:가|이)\s*주문한\s*상품.*카테고리.*리뷰.*(?:평점|평균).*Top\s*(\d+)", {"name": (1,), "limit": (2,)}),
    ("custom_q2", r"(?:top|best)\s*(\d+)\s+(?:rated|review).*(?:same|matching)\s+categor.*(?:as\s+)?(\S+)", {"name": (2,), "limit": (1,)}),
    ("three_hop", r"(?:고객\s*)?" + W + r"(?:가|이)\s*(?:주문|구매)한\s*상품(?:의|.*?)\s*(카테고리|공급업체)", {"name": (1,), "target": (2,)}),
    ("three_hop", r"(?:what\s+)?(categor\w*|supplier\w*)\s+(?:of|for|in)\s+(?:products?\s+)?(?:ordered|bought|purchased)\s+by\s+(\S+)", {"name": (2,), "target": (1,)}),
    ("custom_q4", W + r"(?:와|과)\s*" + W + r"(?:가|이)\s*공통(?:으로)?\s*구매한\s*상품", {"name": (1,), "other": (2,)}),
    ("custom_q4", r"(?:products?|items?)\s+(?:both\s+)?(\S+)\s+and\s+(\S+)\s+(?:both\s+)?(?:bought|purchased|ordered)", {"name": (1,), "other": (2,)}),
    ("reverse_two_hop", W + r"(?:를|을)\s*(?:주문|구매|산)한?\s*고객", {"name": (1,)}),
    ("reverse_two_hop", r"(?:who|which\s+customers?)\s+(?:ordered|bought|purchased)\s+(\S+)|customers?\s+(?:who|that)\s+(?:ordered|bought|purchased)\s+(\S+)", {"name": (1, 2)}),
    ("two_hop", r"(?:고객\s*)?" + W + r"(?:가|이)\s*(?:주문|구매)한\s*상품", {"name": (1,)}),
    ("two_hop", r"(?:what\s+)?products?\s+(?:did|has)\s+(\S+)\s+order", {"name": (1,)}),
    ("agg_with_rel", r"(?:가장\s*)?많이\s*팔린\s*카테고리.*Top\s*(\d+)|Top\s*(\d+).*카테고리.*팔린", {"limit": (1, 2)}),
    ("agg_with_rel", r"top\s*(\d+)\s+(?:best[\s-]*sell|most[\s-]*(?:sold|popular|ordered))\w*\s+categor|(?:best[\s-]*sell|most[\s-]*(?:sold|popular|ordered))\w*\s+categor.*top\s*(\d+)", {"limit": (1, 2)}),
    ("custom_q5", r"쿠폰.*사용.*미사용|미사용.*사용.*비교|쿠폰.*비교", {}),
    ("custom_q5", r"coupon.*(?:used|usage).*(?:unused|without|vs)|(?:compare|comparison).*coupon", {}),
    ("one_hop_out", W + r"(?:의|[은는])\s*(상위\s*카테고리|카테고리|공급업체|위시리스트(?:\s*(?:에\s*있는\s*)?상품)?|주소)", {"name": (1,), "target": (2,)}),
    ("one_hop_out", r"(?:what(?:\s+is)?|show)\s+" + W + r"(?:'s)?\s+(category|supplier|wishlist|address)|(category|supplier|wishlist|address)\s+(?:of|for)\s+(\S+)", {"name": (1, 4), "target": (2, 3)}),
    ("property_lookup", W + r"(?:의|[은는])\s*(이메일\s*주소|이메일|전화번호|전화|가격|재고\s*수량|재고)", {"name": (1,), "target": (2,)}),
    ("property_lookup", r"(?:what(?:\s+is)?)\s+" + W + r"(?:'s)?\s+(email|phone|price|stock|inventory)|(email|phone|price|stock|inventory)\s+(?:of|for)\s+(\S+)", {"name": (1, 4), "target": (2, 3)}),
    ("min_prop", r"가장\s*(?:저렴한|싼)\s*(상품|제품)|(?:least\s+expensive|cheapest)\s+(products?|items?)", {"target": (1, 2)}),
    ("max_prop", r"가장\s*(?:비싼|비싸다)\s*(상품|제품)|most\s+(?:expensive|cheap(?:est)?)\s+(products?|items?)", {"target": (1, 2)}),
    ("count_all", r"총\s*(고객|주문|상품|제품|카테고리|공급업체)\s*(?:건수|수)|(고객|주문|상품|제품|카테고리|공급업체)(?:는|이|가)?\s*(?:총\s*)?몇\s*(?:명|개|건)", {"target": (1, 2)}),
    ("count_all", r"(?:how\s+many|total(?:\s+number\s+of)?)\s+(customers?|orders?|products?|categories|suppliers?)", {"target": (1,)}),
    ("group_count", r"(고객)별\s*(?:주문|상품)\s*(?:수|건수|개수)|(?:orders?|products?)\s+(?:per|by|for\s+each)\s+(customer)", {"target": (1, 2)}),
    ("top_n", r"(카테고리)별\s*(?:주문|상품)\s*(?:수|건수|개수)|(?:orders?|products?)\s+(?:per|by|for\s+each)\s+(category)", {"target": (1, 2)}),
    ("order_shipping", W + r"\s*주문(?:의|[은는])?\s*배송\s*상태", {"name": (1,)}),
    ("order_payment", W + r"\s*주문(?:의|[은는])?\s*결제\s*(?:방법|수단)", {"name": (1,)}),
    ("review_top_n", r"(?:상품별\s*)?(?:리뷰\s*)?평점\s*Top\s*(\d+)|Top\s*(\d+)\s*(?:리뷰\s*)?평점", {"limit": (1, 2)}),
    ("avg_prop", r"(?:전체\s*)?주문(?:의|.*?)\s*평균\s*(?:금액|가격|결제|금)", {}),
    ("shipping_stats", r"배송\s*상태별\s*(?:주문\s*)?(?:건수|수|통계|현황|분포)", {}),
    ("payment_stats", r"결제\s*(?:방법|수단)별\s*(?:주문\s*)?(?:건수|수|통계|현황|분포)", {}),
    ("coupon_orders", W + r"\s*쿠폰(?:을|을?\s*)?\s*사용한\s*주문", {"name": (1,)}),
    ("city_customers", W + r"(?:시|시에|에)\s*거주하는\s*(?:고객|사람|사용자)", {"name": (1,)}),
    ("supplier_compare", W + r"(?:와|과)\s*" + W + r"\s*(?:공급\s*)?상품\s*비교", {"name": (1,), "other": (2,)}),
    ("category_compare", W + r"(?:와|과)\s*" + W + r"\s*카테고리.*(?:많이|더|비교)\s*(?:팔|주문|비교)?", {"name": (1,), "other": (2,)}),
)
AGGREGATE_TEMPLATES = (
    "agg_with_rel custom_q2 custom_q5 min_prop max_prop count_all group_count top_n review_top_n avg_prop "
    "shipping_stats payment_stats supplier_compare category_compare"
).split()
QUESTION_PARAMS = ("name", "other", "target", "limit")


def classify_question(col: Column) -> Column:
    """``struct(template, route, name, other, target, limit)`` of the first matching rule.

    The number of the first matching rule is decided once; parameters are then
    extracted with the pattern of that rule only.
    """
    text = F.coalesce(col, F.lit(""))
    rule = F.when(F.lit(False), F.lit(0))
    for i, (_, pattern, _) in enumerate(QUESTION_RULES):
        rule = rule.when(text.rlike("(?i)" + pattern), i)
    rule = rule.otherwise(-1)

    def fields(number: Column) -> Column:
        known = number >= 0
        names = F.when(known, F.get(F.array(*[F.lit(t) for t, _, _ in QUESTION_RULES]), number))
        params = []
        for p in QUESTION_PARAMS:
            value = F.when(F.lit(False), F.lit(""))
            for i, (_, pattern, groups) in enumerate(QUESTION_RULES):
                if p in groups:
                    found = [F.nullif(F.regexp_extract(text, "(?i)" + pattern, k), F.lit("")) for k in groups[p]]
                    value = value.when(number == i, F.coalesce(*found))
            params.append(value.alias(p))
        route = F.when(~known, "unsupported").when(names.isin(AGGREGATE_TEMPLATES), "cypher_agg").otherwise(
            "cypher_traverse"
        )
        return F.struct(names.alias("template"), route.alias("route"), *params)

    # a one-element array binds the rule number to a variable
    return F.transform(F.array(rule), fields)[0]
