"""A hand-checkable shop: rows of our own in the shape of the sales tables."""

from __future__ import annotations

from loomgraph import EdgeSpec, GraphSpec, NodeSpec, PropertyGraph

SPEC = GraphSpec(
    nodes=(
        NodeSpec("Customer", "customers", "id", {"name": "name"}),
        NodeSpec("Order", "orders", "id", {"status": "status", "total_amount": "total"}),
        NodeSpec("Part", "products", "id", {"name": "name", "price": "price"}),
        NodeSpec("Brand", "categories", "id", {"name": "name"}),
        NodeSpec("Supplier", "suppliers", "id", {"name": "name"}),
        NodeSpec("Coupon", "coupons", "id", {"code": "code", "discount_pct": "pct"}),
        NodeSpec("Event", "reviews", "id", {"rating": "rating"}),
    ),
    edges=(
        EdgeSpec("PLACED", "Customer", "Order", "orders", "customer_id", "id"),
        EdgeSpec("CONTAINS", "Order", "Part", "items", "order_id", "product_id", {"quantity": "quantity"}, ("line",)),
        EdgeSpec("BELONGS_TO", "Part", "Brand", "products", "id", "category_id"),
        EdgeSpec("SUPPLIED_BY", "Part", "Supplier", "products", "id", "supplier_id"),
        EdgeSpec("USED_COUPON", "Order", "Coupon", "orders", "id", "coupon_id"),
        EdgeSpec("REVIEWS", "Event", "Part", "reviews", "id", "product_id"),
        EdgeSpec("PARENT_OF", "Brand", "Brand", "categories", "parent_id", "id"),
    ),
)


def tables(spark):
    def rows(schema, *data):
        return spark.createDataFrame(list(data), schema)

    return {
        "customers": rows("id long, name string", (1, "Ann"), (2, "Bo"), (3, "Cy"), (4, None)),
        "orders": rows(
            "id long, customer_id long, status string, total double, coupon_id long",
            (10, 1, "done", 100.0, 1), (11, 1, "open", 50.5, None), (12, 2, "done", 30.25, None),
            (13, 3, "open", 70.0, 1), (14, 9, "open", 5.0, None),
        ),
        "products": rows(
            "id long, name string, price double, category_id long, supplier_id long",
            (100, "pen", 1.0, 1, 7), (101, "ink", 4.0, 1, 7), (102, "cup", 3.0, 2, 8), (103, "mug", 3.5, 2, 8),
        ),
        "items": rows(
            "line long, order_id long, product_id long, quantity long",
            (1, 10, 100, 1), (2, 10, 101, 2), (3, 10, 100, 5), (4, 11, 102, 1), (5, 12, 100, 1), (6, 12, 103, 1),
            (7, 13, 103, 2), (8, 13, 999, 1), (9, None, 100, 1),
        ),
        "categories": rows("id long, name string, parent_id long", (1, "Desk", None), (2, "Kitchen", 1), (3, "Glass", 2)),
        "suppliers": rows("id long, name string", (7, "North"), (8, "South")),
        "coupons": rows("id long, code string, pct long", (1, "TEN", 10)),
        "reviews": rows(
            "id long, product_id long, rating double", (1, 100, 5.0), (2, 100, 5.0), (3, 100, 4.0), (4, 103, 4.5)
        ),
    }


def graph(spark):
    return PropertyGraph.build(SPEC, tables(spark))


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
