"""Fixed values that must equal the reference's for the same results.

Everything here is a plain value, stated once, in the reference's order.
"""

# Stock codes that are not products (case-sensitive).
NON_PRODUCT_CODES = ["BANK CHARGES", "C2", "DOT", "PADS", "POST", "M"]

# Customers need more than this many invoices to be kept.
MIN_INVOICES_EXCLUSIVE = 3

# Share of held-out customers whose last order is 'train'.
TRAIN_SHARE = 0.8

# Share of users in the training part of the validation split.
VALIDATION_TRAIN_SHARE = 0.8

# Smoothing constant in days_since_ratio.
DAYS_RATIO_SMOOTHING = 0.01

# Prediction threshold used when cutting baskets.
THRESHOLD = 0.09

# Blend weights (boosting leaf-wise, boosting depth-wise, forest, logistic).
BLEND_WEIGHTS = {"gbt_leafwise": 0.2, "gbt_depthwise": 0.5, "forest": 0.1, "logistic": 0.2}

# The 29 candidate features, in the reference's order.
ALL_FEATURES = [
    "user_total_orders", "user_total_items", "user_total_distinct_items",
    "user_average_days_between_orders", "user_order_size_mean", "user_order_size_std",
    "user_order_size_max", "user_total_item_quantity", "user_total_spent",
    "user_sum_days_between_orders", "user_reorder_ratio",
    "order_hour_of_day", "order_dow", "days_since_prior_order", "days_since_ratio",
    "product_orders", "product_reorders", "product_reorder_rate", "product_total_quantity_sold",
    "product_avg_price", "prod_first_buy", "prod_second_buy", "prod_1reorder_ratio",
    "prod_nreorder_ratio",
    "UP_orders", "UP_orders_ratio", "UP_reorder_rate", "UP_total_quantity",
    "UP_order_rate_since_first_order",
]

# Features used by the tree models (23), in the reference's order.
TREE_FEATURES = [
    "user_total_orders", "user_total_items", "user_total_distinct_items",
    "user_average_days_between_orders", "user_order_size_mean", "user_order_size_max",
    "user_order_size_std", "user_total_item_quantity", "user_total_spent",
    "user_sum_days_between_orders", "user_reorder_ratio",
    "order_hour_of_day", "days_since_prior_order", "days_since_ratio",
    "product_reorder_rate", "product_total_quantity_sold", "product_avg_price", "prod_first_buy",
    "prod_1reorder_ratio",
    "UP_orders", "UP_orders_ratio", "UP_total_quantity", "UP_order_rate_since_first_order",
]

# Features used by logistic regression (14), in the reference's order.
LOGISTIC_FEATURES = [
    "user_total_orders", "user_average_days_between_orders", "user_order_size_mean",
    "user_total_item_quantity", "order_hour_of_day", "order_dow", "days_since_ratio",
    "product_orders", "product_avg_price",
    "UP_orders", "UP_total_quantity",
    "user_sum_days_between_orders", "user_reorder_ratio", "prod_1reorder_ratio",
]

# Model settings (rounds, depth, rate, row share, column share).
GBT_LEAFWISE = {"maxIter": 100, "maxDepth": 8, "stepSize": 0.053, "subsamplingRate": 0.95,
                "featureSubsetStrategy": "0.9"}
GBT_DEPTHWISE = {"maxIter": 100, "maxDepth": 8, "stepSize": 0.15, "subsamplingRate": 0.76,
                 "featureSubsetStrategy": "0.95", "minInstancesPerNode": 10}
FOREST = {"numTrees": 100, "maxDepth": 7, "minInstancesPerNode": 50, "featureSubsetStrategy": "sqrt"}
LOGISTIC_C = 100.0

# Caps used by the exploratory histograms.
ORDERS_PER_USER_CAP = 30
PRODUCTS_PER_ORDER_CAP = 60

# Permutation test defaults.
PERMUTATION_REPLICATES = 100
SEED = 42
