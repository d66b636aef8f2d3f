"""Declared schemas. Identifiers are text; quantities and prices stay text until typed."""

from pyspark.sql import types as T

_TEXT, _LONG, _INT, _BOOL, _TIME = (
    T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(),
)
_MONEY = T.DecimalType(18, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# A receiving document as scanned. The two known forms differ in the item fields:
# form 1 has price, form 2 has specification, unitPrice and totalPrice.
RAW_ITEM = _struct(
    name=_TEXT, specification=_TEXT, quantity=_TEXT, unit=_TEXT,
    price=_TEXT, unitPrice=_TEXT, totalPrice=_TEXT,
)
RAW_DOCUMENT = _struct(
    imageName=_TEXT, documentType=_TEXT, documentNumber=_TEXT, date=_TEXT,
    supplier=_TEXT, supplierCode=_TEXT, warehouse=_TEXT, warehouseCode=_TEXT,
    operator=_TEXT, remarks=_TEXT, totalAmount=_TEXT, items=T.ArrayType(RAW_ITEM),
)
# A batch of scanned documents from one image folder.
SCAN_BATCH = _struct(
    folderPath=_TEXT, imagesProcessed=_INT, documents=T.ArrayType(RAW_DOCUMENT)
)

REQUISITION_SHEET = _struct(
    requisition_no=_TEXT, requisition_line=_TEXT, supplier_name=_TEXT, project_name=_TEXT,
    project_type=_TEXT, material_code=_TEXT, price_incl_tax=_MONEY, price_excl_tax=_MONEY,
    purchase_order_no=_TEXT, info=_TEXT,
)
LOG = _struct(run_id=_TEXT, seq=_LONG, level=_TEXT, message=_TEXT, ts=_TIME)
WORKBOOK_ROW = _struct(path=_TEXT, sheet=_TEXT, row=_LONG, cells=T.MapType(_TEXT, _TEXT))
