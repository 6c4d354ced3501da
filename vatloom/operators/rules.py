"""Keyword lists, provider keys, profiles and aliases. All of these are fixed values."""

from __future__ import annotations

# Provider field keys and the fields they fill (compared without case).
PROVIDER_KEYS = {
    "VendorName": "SupplierName", "VendorTaxId": "SupplierTaxCode", "InvoiceId": "InvoiceNumber", "InvoiceDate": "InvoiceDate",
    "SubTotal": "SubtotalAmount", "TotalTax": "VatAmount", "InvoiceTotal": "TotalAmount", "CurrencyCode": "Currency",
    "SupplierName": "SupplierName", "SupplierTaxCode": "SupplierTaxCode", "InvoiceNumber": "InvoiceNumber", "SubtotalAmount": "SubtotalAmount",
    "VatAmount": "VatAmount", "TotalAmount": "TotalAmount", "Notes": "Notes", "DocumentType": "DocumentType",
}

# Keywords in search text.
SUPPLIER = ("don vi ban hang", "nguoi ban", "nha cung cap", "supplier", "vendor", "seller")
TAX_CODE = ("ma so thue", "mst", "tax code")
INVOICE_NUMBER = ("so hoa don", "so hd", "so phieu", "ma hd", "invoice no", "invoice number", "so")
INVOICE_DATE = ("ngay hoa don", "ngay tao", "invoice date", "ngay", "date")
DUE_DATE = ("due date",)
PO_NUMBER = ("po number", "purchase order")
SUBTOTAL = ("cong tien hang", "subtotal", "sub total", "sub_total", "thanh tien chua thue", "tien hang", "thanh tien", "tam tinh")
VAT = ("vat", "thue gtgt", "tien thue gtgt", "gtgt")
TOTAL_WEIGHTS = {"tong thanh toan": 3, "tong cong tien thanh toan": 3, "tong cong": 2, "tong tien": 2, "thanh toan": 2, "tong": 1, "total": 2}
NOTES = ("ghi chu", "note", "notes", "dien giai", "noi dung")
COMPANY = ("cong ty", "cty", "tnhh", "co phan", "doanh nghiep", "hop tac xa")
ADDRESS = ("tp.", "thanh pho", "phuong", "quan", "huyen", "tinh", "duong", "so nha")
NOT_A_VENDOR = ("bill to", "ship to", "tax")
TABLE_COLUMNS = {
    "Description": ("items", "item", "description", "ten hang", "ten mon", "ten"),
    "Quantity": ("quantity", "qty", "sl", "so luong"),
    "UnitPrice": ("unit price", "price", "don gia", "gia"),
    "Amount": ("amount", "thanh tien", "t tien", "tong tien", "tong"),
}
TABLE_FOOTER = (
    "vat", "thue gtgt", "tien thue gtgt", "gtgt", "cong tien hang", "subtotal", "sub total", "thanh tien chua thue", "tien hang", "tam tinh",
    "tong thanh toan", "tong cong", "tong tien", "thanh toan", "tong", "total",
)

# Value patterns.
# Those that texts are searched for begin with the characters that a match can begin with: where none stands, no alternative is tried.
MONEY_PART = r"((?:VND|VNĐ|₫|đ)?\s*\d+(?:[.,\s]\d{3})*(?:[.,]\d+)?\s*(?:VND|VNĐ|₫|đ)?)"
TAX_CODE_VALUE = r"(?U)\d{10}(?:[-\s]?\d{3})?"
NUMBER_VALUE = r"(?i)[A-Z0-9][A-Z0-9\-/.]{2,}"
DATE_VALUE = r"(?=\d)(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[-\s][A-Za-z]{3,9}[-\s]\d{2,4})"
GROUPED_MONEY = r"^\d{1,3}(?:\.\d{3})+$"
RATE_MARKER = r"(?iuU)\d{1,2}(?:[.,]\d+)?\s*%|\bKCT\b|\bKKKNT\b"
CURRENCY_MARKER = r"(?iu)(?:VND|VNĐ|₫|đồng|dong|EUR|USD|GBP|JPY|CNY|€|£|\$)"
URL_LIKE = r"(?i)^(https?://|www\.)|\.[a-z]{2,4}(/\S*)?$"
INVOICE_TITLE = r"(?=[HhIiıİ])(?iuU)(?:HÓA\s*ĐƠN|HOA\s*DON|Invoice)"
RECEIPT_TITLE = r"(?=[BbPpRr])(?iuU)(?:BIÊN\s*LAI|BIEN\s*LAI|PHIẾU\s*THU|PHIEU\s*THU|Receipt)"
RESTAURANT = r"(?=[NnQqRr])(?iuU)(?:NHÀ\s*HÀNG|NHA\s*HANG|QUÁN\s*ĂN|QUAN\s*AN|Restaurant)"
APP_RECEIPT = r"(?=[MmOoSsſGgBbNn])(?iuU)(?:Mã\s*đơn\s*hàng|Order\s*ID|ShopeeFood|GrabFood|Baemin|Now\.vn)"
COMMERCIAL = r"(?=[Cc])(?iuU)Commercial\s*Invoice"
INTERNATIONAL = r"(?=[TtBbPp])(?iuU)(?:Tax\s*Invoice|Bill\s*To|Purchase\s*Order|PO\s*Number)"
TAX_CODE_TEXT = r"(?=[MmTt])(?iuU)(?:Mã\s*số\s*thuế|MST|Tax\s*code)\s*[:\-]?\s*([0-9][0-9\s\-.]{8,18})"
NUMBER_TEXT = r"(?=[SsſIiıİ])(?iuU)(?:Số\s*hóa\s*đơn|Số\s*HĐ|Invoice\s*(?:No|Number)|Số)\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-/.]{2,})"
TOTAL_TEXT = r"(?=[Tt])(?iuU)(?:Tổng\s*thanh\s*toán|Tổng\s*cộng(?:\s*tiền\s*thanh\s*toán)?|Tổng\s*tiền|Tổng)\s*[:\-]?\s*" + MONEY_PART
VAT_TEXT = r"(?=[VvTt])(?iuU)(?:VAT|Thuế\s*GTGT)\D*" + MONEY_PART
SUBTOTAL_TEXT = r"(?=[CcSsſTt])(?iuU)(?:Cộng\s*tiền\s*hàng|Subtotal|Thành\s*tiền\s*chưa\s*thuế|Thành\s*tiền|Tiền\s*hàng)\s*[:\-]?\s*" + MONEY_PART

# What search text without blanks holds wherever a pattern matches: looked for first, as a substring is found far faster than a pattern.
HINTS = {
    INVOICE_TITLE: ("hoadon", "invoice"), RECEIPT_TITLE: ("bienlai", "phieuthu", "receipt"), RESTAURANT: ("nhahang", "quanan", "restaurant"),
    APP_RECEIPT: ("madonhang", "orderid", "shopeefood", "grabfood", "baemin", "now.vn"), COMMERCIAL: ("commercialinvoice",),
    INTERNATIONAL: ("taxinvoice", "billto", "purchaseorder", "ponumber"), TAX_CODE_TEXT: ("masothue", "mst", "taxcode"), NUMBER_TEXT: ("so", "invoiceno", "invoicenumber"),
    TOTAL_TEXT: ("tong",), VAT_TEXT: ("vat", "thuegtgt"), SUBTOTAL_TEXT: ("tienhang", "subtotal", "thanhtien"),
    CURRENCY_MARKER: ("vnd", "₫", "dong", "eur", "usd", "gbp", "jpy", "cny", "€", "£", "$"),
}

# The fields of each profile in order: section, key, severity if it is required and missing, alias.
PROFILES = {
    "VatInvoice": (
        ("invoice", "InvoiceForm", None, None),
        ("invoice", "InvoiceSymbol", None, None),
        ("invoice", "InvoiceNumber", "High", None),
        ("invoice", "InvoiceDate", "High", None),
        ("invoice", "TaxAuthorityCode", None, None),
        ("invoice", "LookupCode", None, None),
        ("invoice", "InvoiceNature", None, None),
        ("seller", "SellerName", "High", "SupplierName"),
        ("seller", "SellerTaxCode", "High", "SupplierTaxCode"),
        ("seller", "SupplierAddress", None, None),
        ("buyer", "BuyerName", None, None),
        ("buyer", "BuyerTaxCode", None, None),
        ("buyer", "BuyerAddress", None, None),
        ("amounts", "SubtotalAmount", None, None),
        ("amounts", "VatAmount", None, None),
        ("amounts", "TotalAmount", "High", None),
        ("amounts", "AmountInWords", None, None),
        ("amounts", "Currency", None, None),
        ("amounts", "PaymentMethod", None, None),
        ("amounts", "Notes", None, None),
    ),
    "PosReceipt": (
        ("merchant", "MerchantName", "High", "SupplierName"),
        ("merchant", "MerchantPhone", None, None),
        ("merchant", "MerchantAddress", None, None),
        ("receipt", "ReceiptNumber", None, "InvoiceNumber"),
        ("receipt", "ReceiptDate", "Warning", "InvoiceDate"),
        ("receipt", "Cashier", None, None),
        ("receipt", "TableNumber", None, None),
        ("amounts", "SubtotalAmount", None, None),
        ("amounts", "DiscountAmount", None, None),
        ("amounts", "TotalAmount", "High", None),
        ("amounts", "Currency", None, None),
        ("notes", "PaymentMethod", None, None),
        ("notes", "Notes", None, None),
    ),
    "AppReceiptScreenshot": (
        ("store", "StoreName", "High", "SupplierName"),
        ("store", "StoreUrl", None, None),
        ("store", "QrCodeValue", None, None),
        ("order", "OrderCode", "High", "InvoiceNumber"),
        ("order", "OrderDate", None, "InvoiceDate"),
        ("order", "CustomerName", None, None),
        ("amounts", "TotalAmount", "Warning", None),
        ("amounts", "Currency", None, None),
        ("notes", "Notes", None, None),
    ),
    "RestaurantBill": (
        ("merchant", "MerchantName", None, "SupplierName"),
        ("merchant", "MerchantPhone", None, None),
        ("merchant", "MerchantAddress", None, None),
        ("bill", "BillNumber", None, "InvoiceNumber"),
        ("bill", "BillDate", None, "InvoiceDate"),
        ("bill", "TableNumber", None, None),
        ("amounts", "TotalAmount", "Warning", None),
        ("amounts", "Currency", None, None),
        ("notes", "Notes", None, None),
    ),
    "CommercialInvoice": (
        ("vendor", "VendorName", "High", "SupplierName"),
        ("vendor", "VendorTaxCode", None, "SupplierTaxCode"),
        ("vendor", "VendorAddress", None, None),
        ("buyer", "BuyerName", None, None),
        ("buyer", "BuyerTaxCode", None, None),
        ("buyer", "BuyerAddress", None, None),
        ("invoice", "InvoiceNumber", "High", None),
        ("invoice", "InvoiceDate", "High", None),
        ("invoice", "DueDate", None, None),
        ("invoice", "PONumber", None, None),
        ("amounts", "SubtotalAmount", None, None),
        ("amounts", "DiscountAmount", None, None),
        ("amounts", "TaxAmount", None, "VatAmount"),
        ("amounts", "TotalAmount", "High", None),
        ("amounts", "Currency", None, None),
        ("notes", "PaymentTerms", None, None),
        ("notes", "Notes", None, None),
    ),
    "Unknown": (
        ("unknown", "SupplierName", "High", None),
        ("unknown", "SupplierTaxCode", "High", None),
        ("unknown", "InvoiceNumber", "High", None),
        ("unknown", "InvoiceDate", "High", None),
        ("unknown", "TotalAmount", "High", None),
        ("unknown", "Currency", None, None),
        ("unknown", "Notes", None, None),
    ),
}
CATEGORY_PROFILE = {
    "VatInvoice": "VatInvoice", "PosReceipt": "PosReceipt", "SalesReceipt": "PosReceipt", "AppReceiptScreenshot": "AppReceiptScreenshot",
    "RestaurantBill": "RestaurantBill", "InternationalInvoice": "CommercialInvoice", "CommercialInvoice": "CommercialInvoice", "Unknown": "Unknown",
}
LEGACY_CATEGORY = {"VatInvoice": "VatInvoice", "PosReceipt": "PosReceipt", "Receipt": "PosReceipt", "RestaurantBill": "RestaurantBill"}
EXPERIMENTAL = ("RestaurantBill",)
ALIASES = {
    "SupplierName": ("SellerName", "MerchantName", "StoreName", "VendorName"),
    "SupplierTaxCode": ("SellerTaxCode", "VendorTaxCode"),
    "InvoiceNumber": ("ReceiptNumber", "BillNumber", "OrderCode"),
    "InvoiceDate": ("ReceiptDate", "BillDate", "OrderDate"),
    "VatAmount": ("TaxAmount",),
}


def profile_rows() -> list[tuple]:
    """(profile, section, section order, key, order, required, severity, alias) of every profile field."""
    rows = []
    for profile, fields in PROFILES.items():
        sections = list(dict.fromkeys(f[0] for f in fields))
        rows += [(profile, section, sections.index(section), key, order, severity is not None, severity, alias) for order, (section, key, severity, alias) in enumerate(fields)]
    return rows


PROFILE_SCHEMA = "profile string, section string, section_order int, field_key string, field_order int, required boolean, severity string, alias string"
