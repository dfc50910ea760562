"""Text patterns of the invoice rules, and a helper that gives them ASCII word edges.

The patterns mean ASCII letters by ``\\b`` and treat no-break spaces as spaces; Java does neither,
so ``portable`` spells both out.
"""

from __future__ import annotations

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_SPACES = "\\s\u00a0\u2007\u202f"
#: The edges in front of a word character and behind one: half the looks of a ``\\b`` there.
BEGIN, END = f"(?<!{_WORD})", f"(?!{_WORD})"


def portable(pattern: str, flags: str = "") -> str:
    """Java form of a pattern: ASCII ``\\b``, ``\\s`` with no-break spaces."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == "\\b" and not in_class:
            out.append(_EDGE)
            i += 2
        elif two == "\\s":
            out.append(_SPACES if in_class else f"[{_SPACES}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            if pattern[i] == "[" and not in_class:
                in_class = True
            elif pattern[i] == "]" and in_class:
                in_class = False
            out.append(pattern[i])
            i += 1
    return (f"(?{flags})" if flags else "") + "".join(out)


# --- fixed values ----------------------------------------------------------------------------
SIGNALS = {
    "reverse_charge": r"reverse charge|article 196|steuerschuldnerschaft des leistungsempfängers|§\s*13\s?b",
    "vat_exempt": r"tax[- ]exempt|steuerfrei|§\s*3\s?a\b|not taxable|nicht steuerbar|leistungsort|place of supply",
    "small_business": r"kleinunternehmer|§\s*19\s+UStG",
    "oss": r"EU OSS VAT|\bOSS\b|one[- ]stop[- ]shop|one[- ]stop\b|umsatzsteuer erklärt durch .{0,60} im lieferland",
    "paid": r"(?<![a-z])(?<!un)paid\b|zahlbetrag|bezahlt|beglichen|per vorkasse",
    "service_words": (
        r"subscription|abonnement|service|dienstleis|development|entwicklung|consulting|beratung|hosting|"
        r"domain\b|usage|credits?\b|fee\b|plan\b|software|licen[cs]e|lizenz|\bapi\b|cloud|\bads\b|advertising|"
        r"kampagne|campaign|support|wartung|mail"
    ),
    "goods_words": (
        r"versandkosten|versand\b|lieferadresse|lieferschein|frachtkosten|shipping|lieferung\b|delivery|"
        r"warenwert|\bware\b|hardware"
    ),
    "refund": r"refunded on|total refunded|refund issued|erstattet am|gutschrift(?!s)",
    "invoice_words": r"invoice|receipt|rechnung|quittung|beleg\b",
    "order_words": (
        r"thank you for your (?:purchase|order)|order summary|order confirmation|bestellbestätigung"
    ),
}
CURRENCY_CODES = ("EUR", "USDT", "USD", "GBP", "CHF")
CURRENCY_SYMBOLS = {"€": "EUR", "$": "USD", "£": "GBP"}
PARSER_CURRENCIES = ("EUR", "USD", "GBP", "CHF")
STATED_CURRENCY = r"(?:amounts displayed in|angabe in|total in)\s*\n?\s*([A-Z]{3,4})\b"

MONTH_NAMES = (
    r"Jan(?:uary|uar)?|Feb(?:ruary|ruar)?|M(?:ar(?:ch)?|är(?:z)?|rz)|Apr(?:il)?|Ma[iy]|Jun[ie]?|Jul[iy]?|"
    r"Aug(?:ust)?|Sep(?:t(?:ember)?)?|O[ck]t(?:ober)?|Nov(?:ember)?|De[cz](?:ember)?"
)
MONTH_NUMBERS = {
    "jan": 1, "feb": 2, "mar": 3, "mär": 3, "mrz": 3, "apr": 4, "may": 5, "mai": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12, "dez": 12,
}

DECIMAL_AMOUNT = r"(?<![\d.,])(?:\d{1,3}(?:[.,]\d{3})+|\d+)[.,]\d{2}(?!(?:[.,]?\d|\s?%))"
TOTALS_RATES = (19, 7, 5)

VAT_ID = (
    r"\b(DE\s?\d{3}\s?\d{3}\s?\d{3}(?!\d)|DE\d{9}(?!\d)|ATU\d{8}|IE\s?\d{7}[A-Z]{1,2}\b|"
    r"IE\d[A-Z0-9+*]\d{5}[A-Z]{1,2}\b|LU\s?\d{8}(?!\d)|EU\s?\d{9}(?!\d)|GB\s?\d{9}(?!\d)|"
    r"NL\s?\d{9}B\d{2}|FR\s?[A-Z0-9]{2}\d{9})"
)
LEGAL_FORM = (
    r"\b(GmbH & Co\. KG|GmbH|mbH|AG|KGaA|e\.K\.|UG(?: \(haftungsbeschränkt\))?|OHG|Inc\.?|LLC|L\.L\.C\.|"
    r"Ltd\.?|Limited|Corp\.?|Corporation|PLC|plc|S\.?[àa] ?r\.?l\.?|SARL|S\.A\.(?:\s+[Dd][Ee]\s+C\.V\.)?|"
    r"B\.V\.|N\.V\.|S\.p\.A\.)(?=[\s,.)]|$)"
)
COUNTRIES = [
    (r"\b(germany|deutschland|bundesrepublik deutschland)\b", "DE"),
    (r"\b(ireland|irland|éire)\b", "IE"),
    (r"\b(united states(?: of america)?|u\.?s\.?a\.?|california|delaware|new york|texas)\b", "US"),
    (r"\bel salvador\b", "SV"),
    (r"\b(luxembourg|luxemburg|lëtzebuerg)\b", "LU"),
    (r"\b(united kingdom|great britain|england|scotland|wales)\b", "GB"),
    (r"\bhong ?kong\b", "HK"),
    (r"\b(china|volksrepublik china)\b", "CN"),
    (r"\b(netherlands|niederlande|nederland)\b", "NL"),
    (r"\b(austria|österreich)\b", "AT"),
    (r"\b(switzerland|schweiz|suisse)\b", "CH"),
    (r"\b(france|frankreich)\b", "FR"),
    (r"\b(italy|italien|italia)\b", "IT"),
    (r"\b(spain|spanien|españa)\b", "ES"),
    (r"\b(poland|polen|polska)\b", "PL"),
    (r"\b(belgium|belgien|belgique)\b", "BE"),
    (r"\b(denmark|dänemark)\b", "DK"),
    (r"\b(sweden|schweden)\b", "SE"),
    (r"\b(czech republic|tschechien)\b", "CZ"),
    (r"\b(canada|kanada)\b", "CA"),
    (r"\b(japan)\b", "JP"),
    (r"\b(india|indien)\b", "IN"),
    (r"\b(singapore|singapur)\b", "SG"),
]
KNOWN_COUNTRIES = (
    "DE IE US SV LU GB HK CN NL AT CH FR IT ES PL BE DK SE CZ CA JP IN SG FI NO PT GR HU RO BG HR SI SK "
    "EE LV LT MT CY AU NZ MX BR AR KR TW AE IL TR UA"
).split()

# label patterns in rank order; (pattern, confidence)
NUMBER_LABELS = [
    (r"(?i)Rechnungsnummer\b", "0.90"),
    (r"(?i)Rechnungs[- ]?Nr\.?(?!\p{L})", "0.90"),
    (r"(?i)Rechnung\s+(?:Nr\.?|Nummer)(?!\p{L})", "0.90"),
    (r"(?i)Invoice\s*(?:number|no\.?|nr\.?)(?!\p{L})", "0.90"),
    (r"(?i)(?:Barverkauf|Beleg)[-\s]?(?:Nr\.?|Nummer)(?!\p{L})", "0.85"),
    (r"(?i)Invoice(?!\S)", "0.70"),
    (r"(?i)Rechnung(?!\S)", "0.70"),
    (r"(?i)Receipt number\b", "0.60"),
]
BARE_NUMBER_LABELS = (5, 6)  # positions of the labels that are trusted only next to their value
DATE_LABELS = [
    (r"(?i)Date paid\b", "0.90"),
    (r"(?i)Invoice date\b", "0.90"),
    (r"(?i)Issue date\b", "0.90"),
    (r"(?i)Rechnungsdatum\b", "0.90"),
    (r"(?i)Belegdatum\b", "0.90"),
    (r"(?i)Ausstellungsdatum\b", "0.90"),
    (r"(?i)Datum\b", "0.85"),
    (r"(?i)Date\b", "0.85"),
]
DUE_LABELS = [
    r"(?i)Fälligkeitsdatum\b", r"(?i)Zahlungsfällig\b", r"(?i)Zahlbar bis\b", r"(?i)Zahlungsziel\b",
    r"(?i)Due date\b", r"(?i)Due\b",
]
PAID_LABELS = [r"(?i)Date paid\b"]
GROSS_LABELS = [
    r"(?i)Amount paid\b", r"(?i)Zahlbetrag\b", r"(?i)Rechnungsbetrag\s*\(brutto\)",
    r"(?i)Summe\s+Rechnungsbetrag\b", r"(?i)Gesamtbetrag\b", r"(?i)Gesamtpreis\b", r"(?i)Endsumme\b",
    r"(?i)Summe\s+Brutto\b", r"(?i)Total\s+amount\b", r"(?i)(?:Vorl\.?\s*)?Ges\.?-?summe\b",
    r"(?i)Total(?:\s+in\s+[A-Z]{3})?(?!\s*(?:excluding|excl|without|refunded|net))\b",
    r"(?i)Rechnungsbetrag\b", r"(?i)Bruttobetrag\b", r"Betrag(?!\S)",
]
SAME_LINE_GROSS_LABEL = 13  # position of the label whose value must be on its own line
NET_LABELS = [
    r"(?i)Total excluding tax\b", r"(?i)Total without (?:VAT|tax)\b",
    r"(?i)Zwischensumme\s*\((?:netto|ohne\s*USt\.?)\)", r"(?i)Nettobetrag\b",
    r"(?i)(?:Entspricht der )?Summe netto\b", r"(?i)Netto Waren?wert\b", r"(?i)Gesamt\s+Netto\b",
    r"(?i)Subtotal(?:\s+in\s+[A-Z]{3})?\b", r"Netto\b(?!\s*[Ww]arenwert)", r"(?i)Net amount\b",
]
# VAT labels; the first seven carry the rate in their first group
VAT_LABELS = [
    r"(?i)VAT\b[^(\n]*\((\d{1,2}(?:[.,]\d{1,2})?)\s*%(?:\s+on\s+[^)]*)?\)\s*$",
    r"(?i)VAT\b[^(\n]*?-\s?(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s+on\s+[^-\n]*?-",
    r"(?i)Umsatzsteuer\s*\((\d{1,2}(?:[.,]\d{1,2})?)\s*%\)",
    r"(?i)Umsatzsteuer\s+(\d{1,2}(?:[.,]\d{1,2})?)\s*%",
    r"(?i)VAT\s+(\d{1,2}(?:[.,]\d{1,2})?)\s*%",
    r"(?i)in[ck]l[.,]?\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s*(?:MwSt|Mwst|USt|Hust|Must)\b\.?",
    r"(?i)\+?\s*(\d{1,2})\s*[%&]\s*USt\b(?:[^€$£\n]*?(?=\s+[€$£]?\s?\d[\d.,]*\s*(?:EUR|USD|GBP|CHF)?\s*$)|.*$)",
    r"(?:MwSt|USt)\.?-?[Bb]etrag\b",
    r"(?i)Gesamt\s*USt\.?(?!\S)",
    r"USt\.?\s*$",
    r"(?i)MwSt\.?(?:\s+MwSt\.?-?Satz)?\s*$",
    r"(?i)Tax(?:es)?(?!\s*(?:ID|No\b|Nr\b|number))\b",
]
RATED_VAT_LABELS = 7
VAT_BASE = r"(?i)[-(]\s?[\d.,]+\s*%\s+on\s+([€$£]?\s*[\d.,]+)"
RATE_WORDING = (
    r"(?:USt\.?|MwSt\.?|Steuersatz|Tax|VAT)[.:%\s]{0,4}(\d{1,2}(?:[.,]\d{1,2})?)\s*%|"
    r"(\d{1,2}(?:[.,]\d{1,2})?)\s*%"
)
WORDING_RATES = (0, 5, 7, 16, 19)
STRONG_NUMBER = (
    r"(?:invoice\s*(?:number|no\.?|nr\.?)|rechnungs(?:nummer|[-\s]?nr\.?)|rechnung\s+(?:nr\.?|nummer)|"
    r"beleg(?:nummer|[-\s]?nr\.?))\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9.\-\/_]{2,24})"
)
WEAK_NUMBER = r"(?:rechnung|invoice)\s*[:#]?\s{1,4}([A-Za-z0-9][A-Za-z0-9.\-\/_]{2,24})"
DATE_BEFORE_GOOD = (
    r"(?:rechnungsdatum|belegdatum|ausstellungsdatum|invoice date|date paid|issue date|date of issue|"
    r"(?<![a-zäöü])datum|(?<![a-z])date)\s*[:.]?\s*[\/\w]{0,14}\s*$"
)
DATE_BEFORE_OTHER = (
    r"(?:vom|bis|bestell|auftrag|versand|liefer|due|fällig|paid on|refund)[a-zäöü.]*\s*:?\s*$"
)
DATE_BEFORE_ORDER = r"(?:vom|bestell|auftrag)[a-zäöü.]*\s*:?\s*$"
# lines around parties
BILL_TO_LINE = r"^(?:bill\s*to|rechnung an|rechnungsadresse|auftraggeber)\s*:?$"
BOILERPLATE_LINE = (
    r"reverse charge|richtlinie|directive|steuerschuldnerschaft|handelsregister|commercial register|electronically|"
    r"cash register|automatically charged|geschäftsbedingungen|kundenservice"
)
TAX_LINE = r"(?:^|\s)(?:VAT|USt\.?|Ust-?Id\S*|MwSt\.?|EIN)\b"
PHONE_LINE = r"^\+?[\d\s()\/.-]{7,}$"
REGISTER_WORDS = r"\b(?:HRB|HRA|IBAN|BIC|Bank)\b"
TAX_NUMBER = r"Steuernummer\s+(\d{2,3}\/\d{3}\/\d{4,5})"
GERMAN_POSTAL = r"\bD(?:E)?[- ]?\d{4,5}\b"
POSTAL_CITY = r"\b\d{5}\s+\p{Lu}"
GERMAN_WORDS = r"Rechnung|USt|MwSt"
# lines of items
SERVICES_LABEL = r"^(?:Services|Dienstleis?t?ungen)(?!\S)"
ITEM_HEADER = r"^(?:Description|Beschreibung|Artikelbezeichnung|Produktbeschreibung|Bezeichnung)\s*:?$"
ITEM_COLUMNS = r"\b(?:Qty|Quantity|Menge|Anzahl|Units?|Preis|Price|Amount|Betrag|Stückpreis|Einh|Tax|USt|MwSt)\b"
ITEM_NOISE = (
    r"reverse charge|richtlinie|directive|steuerschuldnerschaft|incoterms|lieferbedingung|frachtgeb|^asin\b|"
    r"kundenservice|geschäftsbedingungen|vielen dank|thank you|zahlungsreferenz|handelsregister|commercial register"
)
ITEM_TAIL = (
    r"(?:\s+(?:-?[\d.,']+\s?(?:[€$£]|%)?|[€$£]|EUR|USD|USDT|GBP|CHF|Stk\.?|Stück|St\.?|EA|PK|x|\d+\/(?:EA|PK|Stk?)\.?))+$"
)
TOTALS_WORDS = (
    r"\b(?:summe|(?:zahl|gesamt|rechnungs|netto|brutto)?betrag|total|netto|brutto|zwischensumme|ust|mwst|steuer|taxes|"
    r"versand|shipping|subtotal|rabatt|skonto|punkte|visa|iban)\b|str(?:\.|a[sß]se)\s*\d"
)
DATE_LIKE = r"\d{1,2}[.\/]\d{1,2}[.\/]\d{2,4}|\d{4}-\d{2}-\d{2}"
# --- end of fixed values ----------------------------------------------------------------------
