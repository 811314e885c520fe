"""Names, tables and patterns that results depend on, in their natural order."""

TRANSFER_CATEGORY_KEYS = ["creditcardpayment", "creditcardpayments", "internaltransfer", "internaltransfers", "interaccounttransfer", "interaccounttransfers", "usdtocad", "cadtousd"]
TRANSFER_LINK_TYPES = ["CREDIT_CARD_PAYMENT", "INTERNAL_TRANSFER", "FX_CONVERSION", "WISE_TRANSFER"]
NOT_COUNTABLE = ["EXCLUDED"]
ACTIVE_REJECT = "USER_REJECTED"
PROOF_STATUSES = ["AUTO_APPROVED", "USER_APPROVED"]
DISPLAY_STATUSES = ["AUTO_APPROVED", "USER_APPROVED", "PENDING_REVIEW"]
UNCATEGORIZED = "Uncategorized"
FX_MIN, FX_MAX = "1.20", "1.55"
ACCOUNT_ORDER = ["CAD", "USD", "CreditCard", "Wise", "PayPal"]
ETA_SEED_SECONDS = {"receipt": 25.0, "statement": 90.0}

# (name, kind, section, bucket, GIFI code, journal only, operating revenue, scrutiny weight, generic)
TAXONOMY = [
    ("Sales of goods and services", "income", "revenue", "operating_revenue", "8000/8299", False, True, 1.0, False),
    ("All other revenues", "income", "revenue", "non_operating", "8230", False, False, 1.0, False),
    ("Wages and benefits", "cogs", "cost_of_sales", "cost_of_sales", "8340", False, False, 1.0, False),
    ("Purchases, materials and sub-contracts", "cogs", "cost_of_sales", "subcontracts", "8320", False, False, 1.5, False),
    ("Opening inventory", "cogs", "cost_of_sales", "cost_of_sales", "8300", True, False, 1.0, False),
    ("Closing inventory", "cogs_contra", "cost_of_sales", "cost_of_sales", "8500", True, False, 1.0, False),
    ("Labour and commissions", "expense", "operating", "salaries_wages", "9060", False, False, 1.0, False),
    ("Amortization and depletion", "expense", "operating", "cca_depreciation", "8670", True, False, 1.0, False),
    ("Repairs and maintenance", "expense", "operating", "repairs_maintenance", "8960", False, False, 1.0, False),
    ("Utilities and telephone/telecommunication", "expense", "operating", "utilities", "9220/9225", False, False, 1.0, False),
    ("Rent", "expense", "operating", "rent", "8910", False, False, 1.0, False),
    ("Interest and bank charges", "expense", "operating", "interest_bank", "8710/8715", False, False, 1.0, False),
    ("Professional and business fees", "expense", "operating", "professional_fees", "8860", False, False, 1.5, False),
    ("Advertising and promotion", "expense", "operating", "advertising", "8520", False, False, 1.0, False),
    ("Delivery, shipping and warehouse expenses", "expense", "operating", "delivery", "9275", False, False, 1.0, False),
    ("Insurance", "expense", "operating", "insurance", "8690", False, False, 1.0, False),
    ("Travel", "expense", "operating", "travel", "9200", False, False, 2.5, False),
    ("Meals and entertainment", "expense", "operating", "meals_entertainment", "8523", False, False, 2.5, False),
    ("Office supplies", "expense", "operating", "office_supplies", "8811", False, False, 1.0, False),
    ("Software and IT", "expense", "operating", "it_software", "8760", False, False, 1.0, False),
    ("Motor vehicle expenses", "expense", "operating", "motor_vehicle", "9281", False, False, 2.0, False),
    ("Other indirect expenses", "expense", "operating", "other_operating", "9270", False, False, 1.0, True),
    ("Credit card payment", "transfer", "structural", "transfer", None, False, False, 1.0, False),
    ("Internal transfer", "transfer", "structural", "transfer", None, False, False, 1.0, False),
    ("Owner's draw", "expense", "operating", "owner_draw", None, False, False, 1.5, False),
    ("Income tax and GST/HST remittance", "tax", "operating", "income_tax", None, False, False, 1.0, False),
    ("Refund/Credit", "contra", "structural", None, None, False, False, 1.0, False),
]

# Ordered rules, first match wins: (category, settled without a receipt, patterns)
CATEGORY_RULES = [
    ("Sales of goods and services", False, [r"INCOMING\s*WIRE", "INCOMINGWIRE"]),
    ("Sales of goods and services", True, ["DirectDeposit"]),
    ("Internal transfer", True, [r"USD\s*TFR", "USDTFR", r"\[FX\]USD", r"US\$\s*Transfer"]),
    ("All other revenues", True, [r"INTEREST\s*EARNED", "INTERESTEARNED", r"\[IN\]"]),
    ("Income tax and GST/HST remittance", False, ["CANACT", "TXINS", "GST-P", r"CRA\b"]),
    ("Interest and bank charges", True, [
        r"MONTHLY\s*FEE", r"CASH\s*MGMT", r"TRANSACTION\s*FEE", "TRANSACTIONFEE", r"CHEQUE\s*\d+\s*AT\s*\$", r"\[SC\]", r"\[DC\]BR", "ReturnedItemFee", r"RETURNED\s*ITEM", "DepositContents",
        r"DEPOSIT\s*CONTENTS", r"INTEREST\s+PURCHASES", "InterestPaid", "INTERACe-TransferFee", "INTERAC.*TRANSFER.*FEE", "ChequeReturnedNSF", r"\bWISE\s+CHARGE", r"\bCHARGES\s+FOR\s*:",
        r"\bWISE\s+(?:\w+\s+)?FEE\b", r"\bFEE\s+FOR\s*:"]),
    ("Internal transfer", True, [r"^Transfer,[\d-]{6,}", "ABMDeposit", r"ABM\s*Deposit", r"TRANSFER\s*(FROM|TO)\s*SAVINGS", r"TFR\s*(FROM|TO)\s*SAV"]),
    ("Motor vehicle expenses", False, [r"\bFUEL\b", r"GAS\s*STATION", "VEHICLE", "PARKING", r"\bESSO\b", r"\bPETRO", r"\bSHELL\b", r"\bCHEVRON\b"]),
    ("Insurance", False, [r"INSURANCE\s*PREMIUM", "INSURANCE"]),
    ("Credit card payment", True, [r"OnlineTransfer.*TF\d+", r"\[CW\]\s*TF\s*\d+", r"TRSF\s*FROM"]),
    ("Utilities and telephone/telecommunication", False, [r"\bTELECOM\b", r"\bWIRELESS\b", r"\bMOBILE\b", r"\bHYDRO\b", r"ORCHID\s*TELECOM"]),
    ("Software and IT", False, ["GOOGLE.*GSUITE", "JETBRAINS", "ADOBE"]),
    ("Software and IT", False, ["OPENAI", "AWS", r"AMAZON\s*WEB\s*SERVICE", r"GOOGLE\s*AI", "MIDJOURNEY", "LINODE"]),
    ("Purchases, materials and sub-contracts", False, [
        r"WISE\s*PAYMENTS", "WISEMSP", r"WISE\s*MSP", "INTERAC.*ETRNSFR.*FULFILL.*WISE", r"WISE\s*TRANSFER", r"OUTGOING\s*WIRE", "OUTGOINGWIRE", "PAYPALMSP", r"PAYPAL\s*MSP",
        "INTERAC.*TRANSFER.*SENT", "INTERACe-Transfer(?!Fee)"]),
    ("Labour and commissions", True, [r"Cheque.*NO\.", r"\[CK\]NO\."]),
    ("Office supplies", False, ["AMAZON", r"\bELECTRONICS\b", r"BEST\s*BUY", "IKEA"]),
    ("Refund/Credit", False, ["REFUND", "DISPUTE"]),
    ("Purchases, materials and sub-contracts", False, ["UPWORK", "ODESK"]),
    ("Office supplies", False, [r"OFFICE\s*SUPPL", "STATIONERY", "STAPLES"]),
    ("Other indirect expenses", False, ["CLEANING", "JANITORIAL"]),
    ("Software and IT", False, ["ANTHROPIC", "GEMINI", "CLAUDE", "CURSOR"]),
    ("Advertising and promotion", False, ["MAILCHIMP", "SQUARESPACE", "WIXSITE", r"META\s*ADS"]),
]

# (pattern, link type, side, accounts, priority)
TRANSFER_KEYWORDS = [
    (r"OnlineTransfer.*TF\d+", "CREDIT_CARD_PAYMENT", "SOURCE", ["CAD"], 90),
    (r"\[CW\]\s*TF\s*\d+", "CREDIT_CARD_PAYMENT", "SOURCE", ["CAD"], 90),
    (r"PAYMENT\s*-?\s*THANK\s*YOU", "CREDIT_CARD_PAYMENT", "TARGET", ["CreditCard"], 95),
    (r"TRSF\s*FROM", "CREDIT_CARD_PAYMENT", "TARGET", ["CreditCard"], 90),
    (r"US\$\s*Transfer|USDTFR", "FX_CONVERSION", "SOURCE", ["CAD"], 85),
    (r"^Transfer,[\d-]{6,}", "FX_CONVERSION", "TARGET", ["USD"], 80),
    (r"WISEMSP|WISE\s*MSP", "WISE_TRANSFER", "SOURCE", ["CAD"], 85),
    (r"WISE\s*PAYMENTS|WISE\s*TRANSFER", "WISE_TRANSFER", "SOURCE", ["CAD", "USD"], 85),
    (r"from\s*BMO|Funded|Top\s*up", "WISE_TRANSFER", "TARGET", ["Wise"], 80),
    (r"TRSF\s*FROM", "INTERNAL_TRANSFER", "TARGET", ["CAD", "USD"], 65),
    (r"REFUND|CREDIT\s*ADJ|DISPUTE\s*CREDIT", "REFUND", "SOURCE", ["CreditCard"], 60),
]
VALID_ACCOUNT_PAIRS = {
    "CREDIT_CARD_PAYMENT": [("CAD", "CreditCard"), ("USD", "CreditCard")], "INTERNAL_TRANSFER": [("CAD", "USD"), ("USD", "CAD")], "FX_CONVERSION": [("CAD", "USD"), ("USD", "CAD")],
    "WISE_TRANSFER": [("CAD", "Wise"), ("USD", "Wise")], "REFUND": [("CreditCard", "CAD"), ("CreditCard", "USD"), ("Wise", "CAD"), ("Wise", "USD")], "OTHER": [],
}
DATE_WINDOWS = {"CREDIT_CARD_PAYMENT": 7, "INTERNAL_TRANSFER": 4, "FX_CONVERSION": 3, "WISE_TRANSFER": 10, "REFUND": 21, "OTHER": 14}
DATE_TIERS = {
    "CREDIT_CARD_PAYMENT": [(0, 1.0), (1, 0.95), (2, 0.85), (3, 0.70), (5, 0.40), (7, 0.15)], "FX_CONVERSION": [(0, 1.0), (1, 0.90), (2, 0.60), (3, 0.30)],
    "WISE_TRANSFER": [(0, 1.0), (1, 0.95), (2, 0.90), (3, 0.80), (5, 0.60), (7, 0.40), (10, 0.15)], "INTERNAL_TRANSFER": [(0, 1.0), (1, 0.90), (2, 0.70), (3, 0.40)],
    "REFUND": [(0, 1.0), (3, 0.90), (7, 0.75), (14, 0.50), (21, 0.25)],
}
CERTAIN_LINK_TYPES = ["CREDIT_CARD_PAYMENT", "INTERNAL_TRANSFER", "FX_CONVERSION", "WISE_TRANSFER"]

# Vendor keys: (pattern on the first three tokens, key), first match wins
VENDOR_ALIASES = [
    (r"^(amzn|amazon[_\s]*mkt|amazon[_\s]*ca|amazon[_\s]*com|amzn[_\s]*mktp|amazonca|amazon)\b", "amazon"), (r"^(aws|amazon[_\s]*web[_\s]*service)s?\b", "aws"),
    (r"^(wise[_\s]*pmts?|wise[_\s]*payments?|wise[_\s]*transfer|wise[_\s]*msp|wisemsp|wise)\b", "wise"), (r"^(paypal[_\s]*msp|paypalmsp|paypal)\b", "paypal"),
    (r"^(stripe[_\s]*payment|stripe)\b", "stripe"), (r"^(google[_\s]*gsuite|google[_\s]*workspace|google[_\s]*svcs|google[_\s]*cloud|google)\b", "google"),
    (r"^(apple[_\s]*com[_\s]*bill|apple[_\s]*services|apple)\b", "apple"), (r"^(openai|chatgpt)\b", "openai"), (r"^(anthropic|claude)\b", "anthropic"), (r"^(gemini|google[_\s]*ai)\b", "gemini"),
    (r"^(cursor[_\s]*ai|cursor)\b", "cursor"), (r"^(jetbrains)\b", "jetbrains"), (r"^(github)\b", "github"), (r"^(microsoft|msft|msbill)\b", "microsoft"), (r"^(adobe)\b", "adobe"),
    (r"^(netflix)\b", "netflix"), (r"^(spotify)\b", "spotify"), (r"^(uber[_\s]*eats|ubereats)\b", "uber_eats"), (r"^(uber[_\s]*canada|uber)\b", "uber"), (r"^(lyft)\b", "lyft"),
    (r"^(shell|esso|petro[_\s]*canada|chevron|mobil|fuel|gas[_\s]*station)\b", "fuel_station"), (r"^(best[_\s]*buy|bestbuy)\b", "best_buy"), (r"^(staples)\b", "staples"), (r"^(ikea)\b", "ikea"),
    (r"^(orchid[_\s]*telecom)\b", "orchid_telecom"), (r"^(upwork|odesk)\b", "upwork"), (r"^(epic[_\s]*games|epicgames)\b", "epic_games"), (r"^(squarespace)\b", "squarespace"), (r"^(mailchimp)\b", "mailchimp"),
]
PROCESSOR_ACTIONS = [
    (r"^General\s+Currency\s+Conversion\b", "paypal_fx"), (r"^Bank\s+Deposit\s+to\s+PP\s+Account\b", "paypal_funding"), (r"^User\s+Initiated\s+Withdrawal\b", "paypal_withdrawal"),
    (r"^Payment\s+Hold(?:ing)?\b", "paypal_hold"), (r"^Reversal\s+of\s+General\s+Account\s+Hold\b", "paypal_hold"), (r"^Account\s+Hold\s+for\s+Open\s+Authorization\b", "paypal_hold"),
]
PROCESSOR_PREFIX = (
    r"^(?:PreApproved\s+Payment\s+Bill\s+User|Express\s+Checkout\s+Payment|Website\s+Payment|Mobile\s+Payment|Subscription\s+Payment|Recurring\s+Payment|Shopping\s+Cart\s+Payment"
    r"|Virtual\s+Terminal\s+Payment|Mass\s+Pay\s+Payment|Payment\s+Refund|Refund\s+from|Pre-?Authorized\s+Payment\s+to|Payment\s+to|Payment\s+from|Purchase\s+from)\s+"
)
NOISE_TOKENS = (
    r"\b(ca|usa|us|inc|llc|corp|ltd|limited|co|mktp|transaction|purchase|payment|debit|credit|ab|bc|mb|nb|nl|ns|nt|nu|pe|qc|sk|yt"
    r"|halifax|montreal|ottawa|toronto|winnipeg|regina|calgary|edmonton|vancouver)\b"
)

# Fall-back rules from normalised category to bucket: (contained words, bucket, operating revenue, distribution, scrutiny weight)
BUCKET_RULES = [
    (["costofsales", "costofgoodssold", "costofgoods", "cogs"], "cost_of_sales", False, False, 1.0),
    (["salestax", "gsthst", "gstpayable", "hstpayable", "pstpayable", "taxremittance", "taxpayable", "remittance", "revenuecanada", "receivergeneral"], "non_operating", False, False, 1.0),
    (["clientrevenue", "revenue", "sales", "invoicepaid"], "operating_revenue", True, False, 1.0),
    (["ownerdraw", "ownersdraw", "ownerwithdrawal", "dividend", "shareholder", "distribution"], "distribution", False, True, 1.5),
    (["taxrefund", "refund", "interestincome", "grant", "capitalinjection", "loanproceeds"], "non_operating", False, False, 1.0),
    (["contractor", "subcontract", "upwork", "freelance", "profession"], "subcontracts", False, False, 1.5),
    (["cloud", "infrastructure", "software", "saas", "hosting", "openai", "genai", "artificialintelligence"], "it_software", False, False, 1.0),
    (["travel", "flight", "airfare", "hotel", "mileage"], "travel", False, False, 2.5),
    (["meal", "entertain", "restaurant"], "meals_entertainment", False, False, 2.5),
    (["vehicle", "motor", "gas", "fuel", "auto"], "motor_vehicle", False, False, 2.0),
    (["insurance"], "insurance", False, False, 1.0),
    (["rent", "lease"], "rent", False, False, 1.0),
    (["repair", "maintenance"], "repairs_maintenance", False, False, 1.0),
    (["advertis", "marketing"], "advertising", False, False, 1.0),
    (["wage", "payroll", "salary"], "salaries_wages", False, False, 1.0),
    (["bankfee", "bankcharge", "interest"], "interest_bank", False, False, 1.0),
]

# Tax codes and the places they depend on
PROVINCES = "AB BC MB NB NL NS NT NU ON PE QC SK YT".split()
US_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC PR".split()
FOREIGN_COUNTRIES = (
    "USA DEU GBR IRL NLD FRA AUS NZL SGP JPN KOR CHN HKG TWN IND CHE SWE NOR DNK FIN ESP ITA PRT POL CZE ROU UKR BRA MEX ARG ZAF ARE ISR PHL VNM THA IDN MYS TUR EST LTU LVA BGR HRV GRC HUN SVK SVN AUT BEL "
    "LUX ISL COL CHL PER NGA KEN EGY SAU PAK BGD LKA NPL"
).split()
FOREIGN_REGIONS = ["US", "UK", "EU", "GB"]
INTERMEDIARIES = ["WISEMSP", r"WISE\s*MSP", r"WISE\s*PAYMENTS", "PAYPALMSP", r"PAYPAL\s*MSP", "INTERACe-Transfer(?:Sent|Fulfill)", "INTERAC.*TRANSFER.*SENT", r"OUTGOING\s*WIRE", "OUTGOINGWIRE"]
CANADIAN_TAX_RATES = [5, 12, 13, 14, 15]

# Patterns that document relevance counts (case is ignored), and the weights of its factors
MONEY_PATTERN = r"\$\s*[\d,]+\.?\d*|(?:CAD|USD|EUR|GBP)\s*[\d,]+\.?\d*|\d{1,3}(?:,\d{3})+\.\d{2}|\d+\.\d{2}\b"
DATE_PATTERN = (
    r"\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{1,2},?\s*\d{4}"
    r"|\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\s+\d{4}"
)
STRUCTURE_PATTERN = (
    r"\binvoice\b|\breceipt\b|\bstatement\b|\bbill\b|\binvoice\s*#|\border\s*#|\btransaction\s*id|\bsubtotal\b|\btax\b|\bgst\b|\bhst\b|\bpst\b|\btotal\s*(?:due|amount|paid|charged)"
    r"|\bpayment\s*(?:method|received|confirmation)|\baccount\s*(?:number|#|no)|\bdue\s*date\b|\bbilling\s*(?:period|date)"
)
PARTY_PATTERN = r"\b(?:from|to|payee|payer|vendor|merchant|sold\s*to|bill\s*to|ship\s*to|customer|client)\s*[:\-]?\s*\w"
BUSINESS_PATTERN = (
    r"\bsoftware\b|\bcloud\b|\bhosting\b|\bserver\b|\bdomain\b|\bsubscription\b|\blicense\b|\bSaaS\b|\bAPI\b|\boffice\b|\brent\b|\butilities?\b|\binternet\b|\btelecom|\binsurance\b|\blegal\b|\baccounting\b|\bconsult"
    r"|\bcontract\b|\bfreelance\b|\bcontractor\b|\btravel\b|\bflight\b|\bhotel\b|\bairfare\b|\bequipment\b|\bhardware\b|\blaptop\b|\bmonitor\b|\badvertis|\bmarketing\b|\bad\s*spend\b|\bcampaign\b|\bpayroll\b|\bwage\b|\bsalary\b"
    r"|\bbank\b|\btransfer\b|\bwire\b|\binterac\b|\butility\b|\bhydro\b|\belectric\b|\bgas\s*co\b|\bcompute\b|\bstorage\b|\bbandwidth\b|\bregistrar\b|\bdata\s*cent(?:er|re)\b|\bplatform\s*fee\b|\bprocessing\s*fee\b|\bseats?\b|\bworkspace\b"
    r"|\bpaypal\b|\bwise\b|\binvoice\b|\breceipt\b"
)
RAIL_PATTERN = r"\bpaypal\b|\bwise\b|\binterac\b"
PERSONAL_PATTERN = r"\b(grocer|restaurant|cafe|coffee|gym|fitness|pharmacy|clinic|dental|salon|cinema|streaming|apparel|clothing|fast\s*food|meal\s*delivery)\b"
RELEVANCE_WEIGHTS = {"monetary_amount": 0.25, "transaction_parties": 0.20, "transaction_date": 0.15, "business_relevance": 0.20, "document_structure": 0.10, "completeness": 0.10}
RELEVANCE_THRESHOLD = 0.40

# Words of a bank line that name no party, and rails, which name the pipe and not the payee
BANK_NOISE = [
    "pos", "purchase", "payment", "paymnt", "pmt", "debit", "credit", "card", "visa", "mastercard", "amex", "interac", "etransfer", "transfer", "sent", "recv", "received", "deposit", "withdrawal", "withdraw",
    "atm", "abm", "cash", "cheque", "check", "chq", "fee", "fees", "service", "charge", "charges", "internet", "online", "banking", "bill", "billpay", "invoice", "monthly", "annual", "recurring",
    "subscription", "misc", "miscellaneous", "merchandise", "store", "retail", "inc", "ltd", "llc", "corp", "co", "company", "canada", "cad", "usd",
    "halifax", "montreal", "ottawa", "toronto", "winnipeg", "regina", "calgary", "edmonton", "vancouver",
    "www", "com", "net", "org", "http", "https", "ref", "reference", "trace", "confirmation", "authorization", "auth", "trsf", "trf", "dep", "wire",
    "mktp", "pymt", "outgoing", "incoming", "preauth", "preauthorized",
]
PAYMENT_RAILS = ["wise", "wisemsp", "transferwise", "paypal", "paypalmsp", "interac", "payoneer", "remitly", "moneygram"]

# Summary lines of statements that are no transactions
SUMMARY_LINES = [
    "Opening Balance", "Closing Balance", "Brought Forward", "Carried Forward", "Previous Balance", "Balance Forward", "Total Withdrawals", "Total Deposits", "Total Debits", "Total Credits",
    "Subtotal", "Statement Period", "Minimum Payment", "Interest Summary", "Daily Balance Summary",
]

# Labels of transfer links, industries with a benchmark, and the prefix of fee rows
LINK_LABELS = {
    "CREDIT_CARD_PAYMENT": "Credit card payment", "INTERNAL_TRANSFER": "Internal bank transfer", "FX_CONVERSION": "Foreign exchange conversion", "WISE_TRANSFER": "Wise account transfer",
    "REFUND": "Refund/credit", "OTHER": "Cross-statement transfer",
}
INDUSTRY_CODES = {"Software & Technology": "5415", "Consulting & Professional Services": "5416", "Food & Hospitality": "7225", "Construction & Trades": "2361"}
FEE_TYPES = ["FEE", "FEES"]
FEE_PREFIX = "Wise fee: "
WISE_LINES = [r"WISE\s*PAYMENTS", "WISEMSP", r"WISE\s*MSP", r"WISE\s*TRANSFER"]

# Fixed values of extracted statements: months, marks of a business statement, lines that are no rows, words of incoming money, dates
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
BUSINESS_STATEMENT = ["bmo", "business banking", r"opening\s*balance", r"closing\s*totals"]
STATEMENT_TOTALS = ["openingbalance", "closingtotals", "closingbalance", "numberofitems"]
CREDIT_HINTS = ["INCOMING", "DEPOSIT", "INTEREST", "CREDIT", "REFUND"]
STATEMENT_DATES = ["yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "M/d/yy", "MMM d, yyyy", "MMM d yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d-MMM-yyyy", "d MMM yyyy"]

# Fixed values of page batches: identity fields, figures that stand with the total, the vendor of pages that are no financial document
IDENTITY_FIELDS = ["vendor", "date", "payment_date", "currency", "currency_marker", "payment_method", "invoice_number", "purpose"]
TOTAL_SIBLINGS = ["subtotal", "gst", "hst", "pst", "other_tax", "amount"]
NOT_FINANCIAL = "NOT_A_FINANCIAL_DOCUMENT"

# Fixed values of hand-kept workbooks: sheet names by kind, header labels, currencies of sections (the first is assumed), spellings
SHEETS_SKIPPED = ["index", "contents", "summary", "notes", "total", "orders"]
CARD_SHEETS = ["credit card", "creditcard", "credit_card", "card"]
SECTION_SHEETS = ["cad", "usd", "cny", "eur", "gbp", "currency", "chequing", "checking", "bank"]
SECTION_HEADER = ["transaction type", "date posted", "transaction amount", "description"]
CARD_HEADER = ["transaction date", "posting date", "transaction amount", "description"]
SECTION_CURRENCIES = ["CAD", "USD", "CNY", "EUR", "GBP"]
CATEGORY_SPELLINGS = {"Bank fees": "Interest and bank charges", "office supplies": "Office supplies", "Office supply": "Office supplies"}

# Fixed values of benchmark files: label of a line's block and its bucket, labels of the quartile columns in a block
BENCHMARK_LINES = {
    "cost of sales (direct expenses)": "cost_of_sales",
    "wages and benefits": "employee_benefits",
    "purchases, materials and sub-contracts": "subcontracts",
    "labour and commissions": "salaries_wages",
    "amortization and depletion": "cca_depreciation",
    "repairs and maintenance": "repairs_maintenance",
    "utilities and telephone/telecommunication": "utilities",
    "rent": "rent",
    "interest and bank charges": "interest_bank",
    "professional and business fees": "professional_fees",
    "advertising and promotion": "advertising",
    "delivery, shipping and warehouse": "delivery",
    "insurance": "insurance",
    "other expenses": "other_operating",
    "net profit/loss": "net_profit_margin",
}
QUARTILE_LABELS = ["bottom quartile", "lower middle", "upper middle", "top quartile"]
