"""A gate for SQL statements, and templated answers to a log of business questions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import exact
from .advice import number, rounded, tenths, text
from .products import PAIR, sums, totals_by

# Words that make a statement unsafe, and the phrases of every question type.
FORBIDDEN = ["DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "EXEC", "--", ";--"]
READ_ONLY_STARTS = ["SELECT", "WITH"]
INTENTS = {
    "best_sellers": ["best-selling", "best selling", "top product", "top-selling"],
    "worst_region": ["worst region", "worst performing region", "which region performed worst"],
    "losing_products": ["losing money", "losing-money", "unprofitable", "low margin products"],
    "churn_risk": ["likely to churn", "churn risk", "at risk customers", "who is going to churn"],
    "month_over_month": ["compare this month", "month over month", "vs last month", "compared to last month"],
}
ROOT_CAUSE = (("why", "revenue"),)
RECOMMENDATIONS = (("what should",), ("recommend",))
BEST_SELLERS = 5
LOSING_PRODUCTS = 8
THIN_MARGIN = "0.05"
RISK_SEGMENTS = ["At Risk", "Dormant"]


# --- the gate ----------------------------------------------------------------

def sql_is_safe(statement: Column) -> Column:
    """Reads only: starts with SELECT or WITH and holds no forbidden word, not even inside another word."""
    upper = F.upper(statement)
    head = F.regexp_replace(upper, r"(?U)^\s+", "")
    starts = reduce(lambda a, b: a | b, [F.startswith(head, F.lit(w)) for w in READ_ONLY_STARTS])
    hits = reduce(lambda a, b: a | b, [F.contains(upper, F.lit(w)) for w in FORBIDDEN])
    return exact.flag(starts & ~hits)


def guarded_query(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Runs one statement over the named tables (written {name}) if it only reads, and refuses it otherwise."""
    checked = spark.createDataFrame([(statement,)], "statement string").select(sql_is_safe(F.col("statement"))).first()[0]
    if not checked:
        raise ValueError("Refused: not a read-only SELECT or WITH statement.")
    named = {f"__guarded_{name}": df for name, df in tables.items()}
    plain = statement.format(**{name: f"__guarded_{name}" for name in tables})
    refused = _beyond_tables(spark, plain, set(named))
    if refused:
        raise ValueError(f"Refused: {refused}.")
    return spark.sql(statement, **tables)


# What a statement may be made of, by class of the parsed plan; anything else is refused.
PLAN_NODES = {
    "UnresolvedWith", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "OneRowRelation", "Project", "Filter", "Join", "Aggregate",
    "UnresolvedHaving", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "WithWindowDefinition"}
EXPRESSIONS = {
    "Literal", "Alias", "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedStar", "UnresolvedOrdinal", "UnresolvedFunction", "UnresolvedExtractValue",
    "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "Between", "IsNull", "IsNotNull",
    "In", "InSubquery", "ListQuery", "ScalarSubquery", "Exists", "Like", "ILike", "RLike", "Add", "Subtract", "Multiply", "Divide", "IntegralDivide", "Remainder",
    "UnaryMinus", "UnaryPositive", "Concat", "Cast", "CaseWhen", "If", "SortOrder", "WindowExpression", "UnresolvedWindowExpression", "WindowSpecDefinition",
    "SpecifiedWindowFrame", "UnspecifiedFrame", "UnboundedPreceding", "UnboundedFollowing", "CurrentRow", "WindowSpecReference"}
FUNCTIONS = {
    "+", "-", "*", "/", "%", "||", "abs", "add_months", "any_value", "avg", "between", "bool_and", "bool_or", "ceil", "ceiling", "char_length", "coalesce", "concat",
    "concat_ws", "contains", "corr", "count", "count_if", "cume_dist", "current_date", "date", "date_add", "date_diff", "date_format", "date_part", "date_sub", "date_trunc",
    "datediff", "day", "dayofmonth", "dayofweek", "dense_rank", "div", "endswith", "exp", "extract", "first", "first_value", "floor", "greatest", "hour", "if", "ifnull",
    "initcap", "lag", "last", "last_day", "last_value", "lead", "least", "left", "length", "ln", "log", "lower", "ltrim", "make_date", "max", "max_by", "mean", "median",
    "min", "min_by", "minute", "mod", "month", "months_between", "ntile", "nullif", "nvl", "percent_rank", "percentile", "percentile_approx", "pow", "power", "quarter",
    "rank", "replace", "right", "round", "row_number", "rtrim", "sign", "split_part", "sqrt", "startswith", "std", "stddev", "stddev_pop", "stddev_samp", "substr", "substring",
    "sum", "to_date", "trim", "trunc", "try_divide", "upper", "var_pop", "var_samp", "variance", "weekofyear", "year"}
BUILT_IN = "org.apache.spark.sql.catalyst.expressions."


def _items(spark: SparkSession, values) -> list:
    return list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(values))


def _beyond_tables(spark: SparkSession, statement: str, known: set[str]) -> str:
    """What the parsed statement is made of besides the known tables and the listed nodes and functions; empty if nothing."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception:  # the parser's own error, whatever the statement holds
        return "it is not one statement that can be parsed"
    relations, own, called = set(), set(), set()
    waiting = [(plan, PLAN_NODES)]
    while waiting:
        node, listed = waiting.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in listed:
            return f"it holds {kind}"
        if kind == "UnresolvedRelation":
            relations.add(".".join(_items(spark, node.multipartIdentifier())))
        elif kind == "UnresolvedWith":
            own |= {_items(spark, relation.productIterator().toSeq())[0] for relation in _items(spark, node.cteRelations())}
        elif kind == "UnresolvedFunction":
            called.add(".".join(_items(spark, node.nameParts())).lower())
        if listed is PLAN_NODES:
            waiting += [(inner, PLAN_NODES) for inner in _items(spark, node.innerChildren())]
            waiting += [(expression, EXPRESSIONS) for expression in _items(spark, node.expressions())]
        elif kind in ("ListQuery", "ScalarSubquery", "Exists"):
            waiting.append((node.plan(), PLAN_NODES))
        waiting += [(child, listed) for child in _items(spark, node.children())]
    if relations - known - own:
        return f"it reads {min(relations - known - own)}"
    for name in sorted(called):
        # A function of this session may bear the name of a listed one.
        if name not in FUNCTIONS or not _built_in(spark, name):
            return f"it calls {name}"
    return ""


def _built_in(spark: SparkSession, name: str) -> bool:
    return (spark.catalog.getFunction(name).className or "").startswith(BUILT_IN)


# --- questions ---------------------------------------------------------------

def _mentions(question: Column, alternatives) -> Column:
    def every(phrases) -> Column:
        return reduce(lambda a, b: a & b, [F.contains(question, F.lit(p)) for p in phrases])
    return reduce(lambda a, b: a | b, [every(phrases) for phrases in alternatives])


def intent_of(question: Column) -> Column:
    """Question type by phrase; types earlier in the list win."""
    lower = F.lower(question)
    rules = [(intent, [(p,) for p in phrases]) for intent, phrases in INTENTS.items()]
    rules += [("root_cause", ROOT_CAUSE), ("recommendations", RECOMMENDATIONS)]
    branches = F.when(_mentions(lower, rules[0][1]), rules[0][0])
    for intent, alternatives in rules[1:]:
        branches = branches.when(_mentions(lower, alternatives), intent)
    return branches.otherwise("unknown")


def classify_questions(questions: DataFrame) -> DataFrame:
    return questions.withColumn("intent", intent_of(F.col("question")))


def answer_best_sellers(sales: DataFrame, products: DataFrame) -> DataFrame:
    totals = totals_by(sales, products, PAIR, ["revenue", "orders"])
    return totals.orderBy(F.desc("revenue"), *PAIR).limit(BEST_SELLERS)


def answer_worst_region(sales: DataFrame) -> DataFrame:
    per_region = sales.groupBy("region").agg(*sums(sales, ["revenue", "profit", "orders"]))
    return per_region.orderBy("revenue", "region")


def losing_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    """All products with a loss or a margin below 5 %."""
    totals = totals_by(sales, products, PAIR, ["revenue", "profit", "orders"])
    thin = (F.col("revenue") > 0) & (F.col("profit") < F.col("revenue") * F.lit(THIN_MARGIN).cast("decimal(4,2)"))
    negative = (F.col("revenue") < 0) & (F.col("profit") > F.col("revenue") * F.lit(THIN_MARGIN).cast("decimal(4,2)"))
    return totals.where((F.col("profit") < 0) | thin | negative)


def answer_losing_products(sales: DataFrame, products: DataFrame) -> DataFrame:
    """The worst of them; how many there are is `losing_products`."""
    return losing_products(sales, products).orderBy("profit", *PAIR).limit(LOSING_PRODUCTS)


def answer_churn_risk(segmented: DataFrame) -> DataFrame:
    """Customers (with their segment applied) in the two risky segments."""
    risky = segmented.where(F.col("customer_segment").isin(*RISK_SEGMENTS))
    return risky.groupBy("customer_segment").agg(F.count("*").alias("customers")).orderBy("customer_segment")


def answer_mom(sales: DataFrame) -> DataFrame:
    """The two latest months that have orders, side by side; no row with fewer than two."""
    month = F.trunc("order_date", "month").alias("month")
    monthly = sales.groupBy(month).agg(*sums(sales, ["revenue", "profit", "orders"]))
    two = monthly.orderBy(F.desc("month")).limit(2)
    pair = two.agg(F.max(F.struct("month", "revenue", "profit", "orders")).alias("this"),
                   F.min(F.struct("month", "revenue", "profit", "orders")).alias("last"), F.count("*").alias("n"))
    change = F.col("this.revenue") - F.col("last.revenue")
    tenth = exact.half_up(exact.cents(change), exact.cents(F.col("last.revenue")), 1000)
    return pair.where(F.col("n") == 2).select(
        F.col("this.month").alias("this_month"), F.col("this.revenue").alias("this_revenue"),
        F.col("this.orders").alias("this_orders"), F.col("last.month").alias("last_month"),
        F.col("last.revenue").alias("last_revenue"), F.col("last.orders").alias("last_orders"),
        F.coalesce(tenth.cast("double") / 10, F.lit(0.0)).alias("change_pct"))


# --- worded answers ----------------------------------------------------------

_COLUMNS = ["intent", "answer", "evidence", "explanation", "recommendation", "confidence", "note"]


def _worded(df: DataFrame, intent: str, answer: Column, evidence: Column, explanation: str = "", recommendation: str = "",
            confidence: str = "N/A", note: str = "") -> DataFrame:
    return df.select(
        F.lit(intent).alias("intent"), answer.alias("answer"), evidence.alias("evidence"),
        F.lit(explanation).alias("explanation"), F.lit(recommendation).alias("recommendation"),
        F.lit(confidence).alias("confidence"), F.lit(note).alias("note"))


def _listed(df: DataFrame, line: Column, *order: Column) -> DataFrame:
    """One row: number of rows, first row, and one line per row in order (a handful of rows)."""
    entries = F.array_sort(F.collect_list(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("at"),
                                                   line.alias("line"))))
    return df.agg(F.count("*").alias("n"), F.transform(entries, lambda e: e.getField("line")).alias("lines"),
                  *[F.min_by(c, F.struct(*order)).alias(f"first_{c}") for c in df.columns])


def answers(sales: DataFrame, products: DataFrame, segmented: DataFrame) -> DataFrame:
    """One row per question type; every answer is computed once, however often it is asked.

    `sales` may be order lines or a stored monthly summary of them.
    """
    c = F.col
    none = F.array().cast("array<string>")
    best = _listed(
        answer_best_sellers(sales, products),
        text(c("product_name"), " (", c("category"), "): Rs.", rounded(c("revenue")), " in ", c("orders"), " orders"),
        -c("revenue"), c("product_name"), c("category"))
    region = _listed(
        answer_worst_region(sales),
        text(c("region"), ": Rs.", rounded(c("revenue")), " revenue, Rs.", rounded(c("profit")), " profit, ", c("orders"), " orders"),
        c("revenue"), c("region"))
    losing = _listed(
        answer_losing_products(sales, products),
        text(c("product_name"), " (", c("category"), "): Rs.", rounded(c("profit")), " profit on Rs.", rounded(c("revenue")),
             " revenue, ", c("orders"), " orders"),
        c("profit"), c("product_name"), c("category")).withColumn(
            "n", losing_products(sales, products).agg(F.count("*").alias("all")).scalar())
    churn = answer_churn_risk(segmented).agg(
        F.sum("customers").alias("total"),
        F.array_sort(F.collect_list(text(c("customer_segment"), ": ", c("customers"), " customers"))).alias("lines"))
    # An aggregate without grouping has a row even where there are not two months.
    months = answer_mom(sales).agg(*[F.max(n).alias(n) for n in (
        "this_month", "this_revenue", "this_orders", "last_month", "last_revenue", "last_orders", "change_pct")])

    parts = [
        _worded(best, "best_sellers",
                F.when(c("n") > 0, text("The best-selling product by revenue is ", c("first_product_name"), "."))
                .otherwise("There are no orders yet."),
                c("lines"), "Products ranked by revenue over all orders.",
                "Keep these products in stock and feature them.", "High: every order was counted."),
        _worded(region, "worst_region",
                F.when(c("n") > 0, text(c("first_region"), " is the weakest region by revenue, with Rs.",
                                        rounded(c("first_revenue")), "."))
                .otherwise("There are no orders yet."),
                c("lines"), "Regions ranked by revenue over the whole period.",
                "Compare its product mix and marketing with other regions before moving budget.", "High: plain sums."),
        _worded(losing, "losing_products",
                F.when(c("n") > 0, text(c("n"), " products lose money or earn less than 5%; the worst is ",
                                        c("first_product_name"), "."))
                .otherwise("No product loses money or earns less than 5%."),
                c("lines"), "Listed are products with a negative profit or a margin below 5% of revenue.",
                "Review their price and cost; consider dropping those that keep losing.", "High: plain sums."),
        _worded(churn, "churn_risk",
                F.when(c("total").isNotNull(), text(c("total"), " customers are in a segment at risk of leaving."))
                .otherwise("Customers have not been segmented yet."),
                c("lines"), "Based on the segments At Risk and Dormant.",
                "Start with At Risk customers: they spent well and are easier to win back.",
                "Medium to high: segments follow fixed rules; model scores are probabilities."),
        _worded(months, "month_over_month",
                F.when(c("this_month").isNotNull(), text(
                    "Revenue ", F.when(c("change_pct") >= 0, "grew").otherwise("declined"), " by ",
                    tenths(F.abs(F.round(c("change_pct") * 10))), "% from ", c("last_month"), " to ", c("this_month"), "."))
                .otherwise("A comparison needs orders in two months."),
                F.when(c("this_month").isNotNull(), F.array(
                    text(c("this_month"), ": Rs.", rounded(c("this_revenue")), " revenue, ", c("this_orders"), " orders"),
                    text(c("last_month"), ": Rs.", rounded(c("last_revenue")), " revenue, ", c("last_orders"), " orders")))
                .otherwise(none),
                "Total revenue of the two latest months.", "After a decline, compare the periods by slice to find its source.",
                "High: plain sums."),
    ]
    one = sales.sparkSession.range(1)
    parts += [
        _worded(one, "root_cause", F.lit("This question asks for a cause, not a figure."), none,
                note="Compare two periods by slice to see what moved."),
        _worded(one, "recommendations", F.lit("This question asks for advice, not a figure."), none,
                note="See the recommendation cards."),
        _worded(one, "unknown", F.lit("There is no template for this question yet."), none,
                note="Answered are best sellers, worst region, losing products, churn risk and month over month."),
    ]
    return reduce(DataFrame.unionByName, parts).select(*_COLUMNS)


def answer_questions(questions: DataFrame, sales: DataFrame, products: DataFrame, segmented: DataFrame) -> DataFrame:
    """Every question with its answer; there are eight answers, so broadcasting them is bounded."""
    return classify_questions(questions).join(F.broadcast(answers(sales, products, segmented)), "intent", "left")
