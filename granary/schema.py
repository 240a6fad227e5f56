"""Column names, defaults and lookup values used across the package."""

from __future__ import annotations

# --- columns -----------------------------------------------------------------
ITEM = "item_code"
QUANTITIES = ("opening_qty", "in_qty", "out_qty", "closing_qty")
SUMMARY_CORE = (ITEM, *QUANTITIES)
WEEKLY = (ITEM, "week_key", "week_in", "week_out", "week_balance")

# Lifecycle columns of the summary and of the material master, with Spark types.
LIFECYCLE_TYPES = {
    "lifecycle": "string",
    "shelf_life_days": "int",
    "production_date": "date",
    "expiry_date": "date",
    "remaining_shelf_days": "int",
    "launch_date": "date",
    "phase_out_date": "date",
}

# --- fixed values: words found in source files --------------------------------
# Names of the lifecycle columns in source files.
LIFECYCLE_SOURCE_NAMES = {
    "生命周期状态": "lifecycle",
    "保质期天数": "shelf_life_days",
    "生产日期": "production_date",
    "过期日期": "expiry_date",
    "剩余保质期天数": "remaining_shelf_days",
    "新品上市日期": "launch_date",
    "老品下市日期": "phase_out_date",
}
# Lifecycle states in source files.
LIFECYCLE_STATES = {
    "正常在售": "active",
    "新品上市": "launch",
    "老品下市": "phase_out",
    "已淘汰": "obsolete",
}
# Standard ledger fields in source files.
STANDARD_NAMES = {
    "物料编码": "item_code",
    "库存量": "opening_qty",
    "入库数量": "in_qty",
    "出库数量": "out_qty",
    "结存数量": "closing_qty",
}
# Other names of the five standard ledger fields.
COLUMN_ALIASES = {
    "item_code": ("原料编码", "物料号", "物料ID", "材料编码", "物代码", "编码"),
    "opening_qty": ("库存数量", "期初库存", "当前库存", "库存", "结余库存"),
    "in_qty": ("入库数", "进货数量", "收货数量", "本期入库", "入库"),
    "out_qty": ("出库数", "领用数量", "发货数量", "本期出库", "出库"),
    "closing_qty": ("结余数量", "结存", "期末库存", "实际结存", "期末结存"),
}
# Names of the two demand columns.
DEMAND_ALIASES = {
    "item_code": ("物料编码", "物料号", "编码", "item_code", "material_code"),
    "demand_qty": ("需求量", "需求数量", "demand_qty", "demand", "需求"),
}
# Names of the supplier columns of a delivery table.
SUPPLIER_ALIASES = {
    "supplier": ("供应商名称", "供应商", "supplier", "vendor"),
    "planned_date": ("计划交期", "计划日期", "planned_date", "plan_date"),
    "actual_date": ("实际交期", "实际日期", "actual_date", "delivery_date"),
    "qualified_qty": ("合格数量", "合格数", "qualified_qty"),
    "delivered_qty": ("交货总数量", "交货数量", "总数量", "total_qty", "delivery_qty", "delivered_qty"),
}
# Words of a wide ledger: total rows, month-to-date label, opening stock label, code column.
TOTAL_WORDS = ("合计", "总计", "小计")
MONTH_TO_DATE = "本月累计"
OPENING_LABEL = "库存"
CODE_LABEL = "物料编码"
# Mapping from standard fields to the action labels of a wide ledger.
LEDGER_LABELS = {
    "item_code": "物料编码",
    "opening_qty": "库存",
    "in_qty": "入库",
    "out_qty": "出库",
    "closing_qty": "结存",
}

# --- fixed values: thresholds --------------------------------------------------
TOLERANCE = 0.01
Z_SCORE = 3.0
SPARSE_SHARE = 0.10
EXPECTED_WEEKS = 13
PERIOD_DAYS = 91
PERIOD_WEEKS = 13
SLOW_WEEKS = 12
HOLDING_COST_RATE = 0.02
STOCKOUT_COST_RATE = 0.05
ABC_LIMITS = (0.70, 0.90)
XYZ_LIMITS = (0.3, 0.8)
ON_TIME_LIMITS = (0.90, 0.70)
QUALITY_LIMITS = (0.95, 0.85)
DEPENDENCY_LIMITS = (0.30, 0.10)
TIGHT_GAP = 0.10
ADI_LIMIT = 1.32
CV2_LIMIT = 0.49
SEASON = 52
HOLT_POINTS = 8
SEASONAL_POINTS = 104
SEASON_TEST_POINTS = 156
ALPHA, BETA, GAMMA = 0.3, 0.1, 0.1
TSB_ALPHA, TSB_BETA = 0.1, 0.1
IMAPA_WINDOW = 4
INTERVAL_Z = 1.65
LEAD_TIME_WEEKS = 1
ORDER_COST = 100.0
HOLDING_RATE = 0.2
SHELF_SAFETY_SHARE = 0.8
SHELF_MAX_SHARE = 0.6

# --- fixed values: lookups -----------------------------------------------------
SERVICE_Z = {0.999: 3.09, 0.99: 2.33, 0.97: 1.88, 0.95: 1.65, 0.90: 1.28, 0.85: 1.04, 0.80: 0.84}
SERVICE_LEVEL = {
    "AX": 0.99, "AY": 0.97, "AZ": 0.95,
    "BX": 0.97, "BY": 0.95, "BZ": 0.90,
    "CX": 0.95, "CY": 0.90, "CZ": 0.85,
}
DEFAULT_SERVICE_LEVEL = 0.95
# Class -> (policy type, period in weeks, method).
POLICY = {
    "AX": ("fixed_period_fixed_qty", 1, "jit_vmi"),
    "AY": ("fixed_period", 1, "rolling_forecast"),
    "AZ": ("variable", None, "make_to_order"),
    "BX": ("fixed_period_fixed_qty", 1, "eoq"),
    "BY": ("fixed_period", 2, "safety_buffer"),
    "BZ": ("variable", None, "periodic_review"),
    "CX": ("fixed_qty", None, "two_bin"),
    "CY": ("variable", None, "min_max"),
    "CZ": ("variable", None, "order_or_drop"),
}
DEFAULT_POLICY = ("variable", None, "default")
PERIODIC_POLICIES = ("fixed_period_fixed_qty", "fixed_period")
MADE_TO_ORDER = ("AZ", "BZ", "CZ")
# Class -> (count frequency, safety stock rule).
COUNTING = {
    "AX": ("daily", "low"), "AY": ("weekly", "medium"), "AZ": ("fortnightly", "high or by order"),
    "BX": ("weekly", "low"), "BY": ("fortnightly", "medium"), "BZ": ("monthly", "high or by order"),
    "CX": ("monthly", "low"), "CY": ("monthly", "medium"), "CZ": ("quarterly", "by order or drop"),
}
# Method of a policy -> what the buyer does.
REMARKS = {
    "jit_vmi": "let the supplier watch the stock and refill it",
    "rolling_forecast": "send the supplier a new forecast every week",
    "make_to_order": "ask the customer before anything is bought",
    "eoq": "buy the economic quantity each time",
    "safety_buffer": "hold a buffer against late deliveries",
    "periodic_review": "look at the item once a month",
    "two_bin": "reorder when the first of two bins is empty",
    "min_max": "fill up to the maximum once the minimum is reached",
    "order_or_drop": "buy for orders only, or take it out of the range",
}


def _strategy(combo: str) -> tuple[str, str, str, str, str]:
    kind, weeks, method = POLICY[combo]
    words = kind.replace("_", " ") + (f" every {weeks} weeks" if weeks and weeks > 1 else " every week" if weeks else "")
    return (f"{SERVICE_LEVEL[combo]:.0%}", words, *COUNTING[combo], REMARKS[method])


# Class -> (service level, replenishment, count frequency, safety stock rule, remark).
CONTROL_STRATEGY = {combo: _strategy(combo) for combo in POLICY}
DEFAULT_STRATEGY = ("N/A", "undefined", "N/A", "ask an administrator", "")
# Urgency words by ABC class and their ranks.
SHORTAGE_URGENCY = {"A": "urgent", "B": "important"}
REORDER_URGENCY = {"A": "this_week", "B": "this_month"}
URGENCY_RANK = {"urgent": 3, "important": 2, "this_week": 2, "this_month": 1, "normal": 0, "this_quarter": 0}
OVERSTOCK_ACTION = {"A": "return_to_supplier", "B": "promote"}
ALERT_COLOUR = {"A": "red", "B": "orange", "C": "yellow"}
CLASS_SCORE = {"A": 100, "B": 50, "C": 10}
TYPE_SCORE = {"shortage": 200, "reorder": 100}
