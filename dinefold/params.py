"""Parameters and fixed values of the order domain."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

# --- fixed values: words, lists and formats that results depend on -----------

STORE_A = "万荷店"
STORE_B = "保利店"
STORE_C = "湾里店"
STORE_UNKNOWN = "未知门店"
ALL_STORES = "_all_stores"

DINE_IN = "堂食"
PICKUP_TABLE = "外点自取"
BAR_TABLE = "吧台"
TOTAL_ROW = "合计"
DASH = "-"
SNACK_CATEGORY = "对外售卖零食"
PACKING_WORD = "打包"
PRIVATE_WORDS = ("包间", "包房")
AREA_WORDS_A = ("包间", "大厅", "户外")
AREA_WORDS_B = ("包房", "沙发", "户外")
AREA_OTHER = "其他"
LUNCH = "午市"
DINNER = "晚市"
SYSTEM_OPENER = "顾客/系统"
SCAN_OPENER = "扫码点餐"

PACKAGE_PARENT = "套餐"

DRINKS_SOFT = ("调饮汁", "饮料和水果", "茶", "咖啡", "冰淇淋")
DRINKS_ALCOHOL = ("啤酒", "白酒", "葡萄酒", "鸡尾酒", "苏格兰威士忌", "黄酒")
DRINK_CATEGORIES = DRINKS_SOFT + DRINKS_ALCOHOL
SIZE_SUFFIXES = ("小瓶", "大瓶", "杯", "扎", "壶", "盅")

TAKEAWAY_DONE = "已完成"
TAKEAWAY_RETURNED = "已退单"
AMOUNT_COLUMN = "订单金额"
PLATFORM_COLUMN = "订单来源"
STATUS_COLUMN = "订单状态"
VISIT_STORE_COLUMN = "店面"
DELIVERY_WAITING = "待配送"
DELIVERY_DONE = "已送达"
PERSONAL_COLUMNS = ("recipient_name", "recipient_phone", "address")

# Per-capita bands, lower bound inclusive, highest first.
PRICE_BANDS = (("300+", 300), ("200-300", 200), ("150-200", 150), ("100-150", 100), ("<100", None))

ORDERS_SHEET = "店内订单明细"
ITEMS_SHEET = "商品-店内订单明细"
TAKEAWAY_SHEET = "平台外卖订单明细"
POS_ID = "订单号"
TAKEAWAY_ID = "外卖订单号"
ORDER_TIME_COLUMN = "下单时间"
BUSINESS_DATE_COLUMN = "营业日"
STORE_COLUMN = "门店名称"

# --- merge ------------------------------------------------------------------


@dataclass(frozen=True)
class MergeParams:
    """Thresholds of the consumption-group merge."""

    window_hours_regular: int = 2
    window_hours_private: int = 3
    concurrent_minutes: int = 5
    add_on_max_ratio: Decimal = Decimal("0.50")
    anchor_min_amount: Decimal = Decimal("20.0")
    reopen_min_regular: int = 30
    reopen_min_private: int = 120
    small_ratio: Decimal = Decimal("0.30")
    small_line_cnt: int = 2
    score_threshold: int = 60
    small_bonus_low: int = 55
    small_bonus_mid: int = 30
    small_bonus_high: int = 15
    dinner_start_hour: int = 17
    dinner_end_hour: int = 23
    # Ours: hour at which a business day begins.
    cutover_hour: int = 0

    def __post_init__(self):
        if self.concurrent_minutes <= 0:
            raise ValueError("concurrent_minutes must be positive")


@dataclass(frozen=True)
class StoreParams:
    """Thresholds that differ between stores."""

    low_2a: int
    low_2b: int
    low_2c: int
    red_line: int
    area_words: tuple[str, ...]


STORE_DEFAULT = StoreParams(10, 20, 30, 100, AREA_WORDS_A)
STORE_PARAMS = {STORE_B: StoreParams(15, 15, 15, 40, AREA_WORDS_B)}

LATE_DELIVERY_MINUTES = 45
SAME_PARTY_GAP_MINUTES = 90
VISIT_TIME_MINUTES = 5
