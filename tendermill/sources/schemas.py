"""Explicit schemas and the header maps of the two export files."""

from pyspark.sql import types as T


_TYPES = {"long": T.LongType, "string": T.StringType, "date": T.DateType, "double": T.DoubleType}


def _struct(spec: str) -> T.StructType:
    """Schema from ``name type`` pairs, without needing a session at import."""
    fields = (f.split() for f in spec.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in fields])


LOTS = _struct(
    "lot_number long, lot_status string, discipline string, project_name string, open_date date, "
    "close_date date, actor_name string, good_name string, good_count double, unit string, "
    "supplier_qty double, supplier_unit string, winner_name string, unit_price double, "
    "total_price double, currency string"
)

CONTRACTS = _struct(
    "lot_number long, lot_end_date date, contract_number string, contract_signing_date date, "
    "contract_name string, executor_dak string, counterparty_name string, product_name string, "
    "supplier_unit string, quantity double, unit string, unit_price double, product_amount double, "
    "additional_expenses double, total_contract_amount double, contract_currency string, "
    "delivery_conditions string, payment_conditions string, delivery_time_days string, discipline string"
)

STOCK = _struct(
    "date_column date, warehouse string, nomenclature string, currency string, stock_category string, "
    "department string, project_name string, total_price_currency double"
)

CATALOGUE = _struct(
    "metal_product string, diameter double, side_size double, width double, thickness double, "
    "mark_number string, shape string, outer_diameter double, wall_thickness double"
)

# The headers of the export files and the columns they become.
LOT_HEADERS = {
    "Номер лота": "lot_number",
    "Статус лота": "lot_status",
    "Дисциплина": "discipline",
    "Наименование проекта": "project_name",
    "Дата открытия лота": "open_date",
    "Дата закрытия лота": "close_date",
    "Исполнитель МТО (Ф.И.О.)": "actor_name",
    "Наименование ТМЦ": "good_name",
    "Количество ТМЦ": "good_count",
    "Ед. изм. ТМЦ": "unit",
    "Кол-во поставщика": "supplier_qty",
    "Ед.изм. поставщика": "supplier_unit",
    "Присуждено контрагенту": "winner_name",
    "Цена": "unit_price",
    "Сумма контракта": "total_price",
    "Валюты контракта": "currency",
}

CONTRACT_HEADERS = {
    "Номер лота": "lot_number",
    "Дата завершения лота": "lot_end_date",
    "Номер контракта/договора по этому лоту": "contract_number",
    "Дата заключения контракта/договора": "contract_signing_date",
    "Наименование контракта/договора": "contract_name",
    "Исполнитель ДАК": "executor_dak",
    "Наименование контрагента-владельца контракта/договора": "counterparty_name",
    "Наименование товара": "product_name",
    "Ед.изм. поставщика": "supplier_unit",
    "Кол-во": "quantity",
    "Ед. изм.": "unit",
    "Цена за единицу товара": "unit_price",
    "Сумма товара": "product_amount",
    "Доп. расходы": "additional_expenses",
    "Общая сумма контракта по лоту": "total_contract_amount",
    "Валюта контракта/договора": "contract_currency",
    "Условия поставки товара": "delivery_conditions",
    "Условия оплаты": "payment_conditions",
    "Срок/количество дней поставки товара": "delivery_time_days",
    "Дисциплина": "discipline",
}
