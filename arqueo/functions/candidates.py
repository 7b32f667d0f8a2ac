"""Candidates for ten fields in a line of an invoice, and families of manipulating phrases in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from arqueo.functions.identity import fold
from arqueo.functions.times import MONTHS

_ACCENTS = str.maketrans({"a": "[aàáâãä]", "c": "[cç]", "e": "[eèéê]", "i": "[iíï]", "o": "[oóôõ]", "u": "[uúûü]"})
_MONTH = "|".join(w.translate(_ACCENTS) for w in sorted({w for words in MONTHS.values() for w in words.split()}, key=lambda w: (-len(w), w)))
_DATE = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}})(?!\d)|\d{{1,2}}\.?\s*(?:de\s+|of\s+|d['’]\s*)?(?:{_MONTH})\.?,?\s*(?:de\s+|of\s+)?\d{{4}}|(?:{_MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}}"
_NUMBER = r"n(?:[ºo°.]|[úu]m(?:\.|ero)?)?\s*(?:de\s*)?"
_INVOICE = rf"(?<!\p{{L}})(?<!(?:fecha|total|importe|base)\s{{0,3}})(?:ref\.?\s*factura|{_NUMBER}factura|rechnungs(?:nummer|nr\.?)|(?:factura(?:\s+simplificada)?|invoice|facture|fatura|fattura|rechnung)(?:\s*(?:n(?:[ºo°.]|[úu]m(?:\.|ero)?|r\.)|n\.\s*[ºo°]|no\.?|#))?)"
_CLIENT = r"(?iu)client|destinatario|factura[rd]\s+a|facturé\s+à|faturar\s+a|rechnungsempfänger|bill\s+to"
#: field -> (pattern, group) of fields whose candidates are single matches.
PATTERNS = {
    "invoice_number": (rf"(?iu){_INVOICE}\s*[:#]?\s*(?!(?:{_DATE})(?![\p{{L}}\d]))((?-i:\p{{Lu}}{{1,5}})[ ]\d{{4,}}+|(?=\S*\d)[\p{{L}}0-9][\p{{L}}0-9/_-]{{2,}}+)(?![,.]\d{{2}}\b)", 1),
    "order": (r"(?iu)\bPO\s*[-‐-―]\s*\d{4}\s*[-‐-―]\s*\d{3,6}\b", 0),
    "date": (rf"(?iu)(?:fecha|date|data|datum)[^\d]{{0,25}}?[:.]?\s*({_DATE})", 1),
    "supplier_nif": (r"(?iu)(?:NIF|CIF|Tax\s*ID|VAT\s*ID|N\.?\s*[º°]?\s*TVA|USt-?\s*ID|P\.\s*IVA)\s*[:.]?\s*([A-Z]\s*\d{7}\s*[A-Z0-9]|\d{8}[A-Z]|[A-Z]{2}\d{9,12}|\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}|\d{13})\b", 1),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ \u00a0]?[A-Z0-9]){11,40}", 0),
    "currency": (r"(?iu)(?<![A-Z])(?:EUR|USD|GBP|CHF|JPY|MXN|BRL|euros?)(?![A-Z])|MX\$|R\$|[€£¥$]|(?<![A-Z])(?-i:Fr)(?=\s*\d)", 0),
    "tax_rate": (r"(?iu)(?<![\d.,])(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s*(?:de\s+)?(?:I\.?V\.?A|VAT|TVA|MwSt|tax)", 1),
}
_BILLING = r"(?iu)(?:divisa\s+de\s+facturaci[oó]n|billing\s+currency|rechnungsw[aä]hrung|moeda\s+de\s+fatura[cç][aã]o|devise\s+de\s+facturation)\s*[:.]?\s*([A-Z]{3})(?![A-Z])"
#: Lengths of the ISO 13616 register; other countries give no candidate.
IBAN_LENGTHS = {"BE": 16, "BR": 29, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IT": 27, "JP": 23, "NL": 18, "PT": 25}
_LABEL = (
    r"(?iu)(?<![\p{L}])(?:(importe\s+base|base(?:\s+(?:imponible|imposable))?|valor\s+base|subtotal|sous[\-\s]?total|imponibile|zwischensumme|netto)"
    r"|(importe\s+total|valor\s+total|montant\s+total|totale|total(?:\s+(?:factura|a\s+pagar|due))?|gesamt(?:betrag)?)"
    r"|((?:cuota\s+)?(?:[I1l]\.?V\.?A\.?|VAT|TVA|MwSt\.?|tax)))"
)
_RATE = r"(\d{1,2}(?:[.,]\d{1,2})?)\s*%"
_AMOUNT = r"(?<![\d.,])(?:[+\-−]\s*)?\d[\d.,]*(?:[ \u00a0\u202f]\d[\d.,]*)*"

_Pair = "array<struct<field:string,value:string>>"


def _named(field: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))).cast(_Pair)


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _amounts(c: Column, yen: Column | None = None) -> Column:
    """base, tax_amount, total and tax_rate: what stands between a label and the next. A first label counts at the start of the line only;
    an amount has printed cents, and after one without no later one is taken; brackets make it negative. Where yen is true, whole thousands with marks are amounts as well."""
    parts = F.split(F.regexp_replace(c, _LABEL, "\u0001$1\u0003$2\u0003$3\u0002"), "\u0001")
    parts = F.when(F.trim(parts[0]) == "", F.slice(parts, 2, F.size(parts))).otherwise(F.slice(parts, 3, F.size(parts)))

    def one(p: Column) -> Column:
        base, total, tax = (F.split(F.split(p, "\u0002")[0], "\u0003")[i] != "" for i in range(3))
        rest = F.split(p, "\u0002")[1]
        found = _all(F.regexp_replace(rest, _RATE, "%"), rf"\(\s*{_AMOUNT}\s*\)|{_AMOUNT}", 0)
        whole = lambda t: F.coalesce(yen, F.lit(False)) & t.rlike(r"^[+-]?\d{1,3}(?:[,.]\d{3})+$") if yen is not None else F.lit(False)
        bad = F.array_position(F.transform(found, lambda t: ~(t.rlike(r"[.,]\d{2}\s*\)?$") | whole(t))), True)
        found = F.when(bad > 0, F.slice(found, 1, (bad - 1).cast("int"))).otherwise(found)
        found = F.transform(found, lambda t: F.when(t.startswith("("), F.concat(F.lit("-"), F.regexp_replace(t, r"[()]|^\(\s*|\s*\)$", ""))).otherwise(t))
        field = F.when(base, "base").when(total, "total").otherwise("tax_amount")
        values = F.transform(found, lambda v: F.struct(field.alias("field"), v.alias("value"))).cast(_Pair)
        return F.concat(values, F.when(tax, _named("tax_rate", _all(rest, _RATE, 1))).otherwise(F.array().cast(_Pair)))

    return F.flatten(F.transform(parts, one))


def candidates(c: Column) -> Column:
    """Array of (field, value) for the ten fields of a line, values as printed; an IBAN without blanks and cut to its country's length.

    A client's line gives no tax number, and a line without a label no IBAN.
    """
    v = {f: _all(c, p, g) for f, (p, g) in PATTERNS.items()}
    none = F.array().cast("array<string>")
    v["invoice_number"] = F.transform(v["invoice_number"], lambda x: F.regexp_replace(x, r"(?iu)(?:fecha|date)[:.\s]*\d.*$", ""))
    v["supplier_nif"] = F.when(c.rlike(_CLIENT), none).otherwise(v["supplier_nif"])
    length = F.create_map(*[F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv])

    def cut(x: Column) -> Column:
        plain = F.regexp_replace(x, r"[ \u00a0]", "")
        n = F.try_element_at(length, F.substring(plain, 1, 2))
        return F.when(F.length(plain) >= n, F.left(plain, n))

    v["iban"] = F.when(c.rlike(r"(?iu)[I1l]BAN|cuenta\s+(?:de\s+)?abono"), F.array_compact(F.transform(v["iban"], cut))).otherwise(none)
    v["currency"] = F.concat(v["currency"], _all(c, _BILLING, 1))
    return F.concat(*[_named(f, x) for f, x in v.items()], _amounts(c))


# Labels of the tolerant profile.
_T_INVOICE = r"(?:factura(?:\s+simplificada)?|invoice|facture|fatura|fattura|rechnung)\s*(?:n(?:[ºo°.]|[úu]m(?:\.|ero)?|r\.)?|n\.\s*[ºo°]|no\.?|#)?"
_T_DATE = r"(?:fecha(?:\s+(?:de\s+emisi[oó]n|factura))?|date(?:\s+(?:d['’]?émission|of\s+issue|issue))?|data(?:\s+(?:d['’]?emissi[oó]n|de\s+emiss[aã]o))?|ausstellungsdatum)"
_T_ORDER = r"(?:ref\.?\s*pedido|pedido(?:\s+(?:asociado|cliente))?|su\s+pedido|po|purchase\s+order|bon\s+de\s+commande|comanda|encomenda|ordine|bestellung)"
_T_TAX_ID = r"(?:nif|cif|tax\s*id|vat\s*id|n[ºo°.]?\s*tva|p\.?\s*iva|ust[\-\s]?id|uid|iva)"
_T_CLIENT = r"(?iu)cliente|client|bill\s*to|facturar\s*a|faturar\s*a|factur[ée]\s*[àa]|destinatario|rechnungsempf[äa]nger"
_T_CODE = r"(?<![A-Z0-9])(?:EUR|USD|GBP|CHF|JPY|BRL|MXN)(?![A-Z0-9])"
_T_CURRENCY = rf"(?iu){_T_CODE}|R\$|MX\$|€|£"
_T_PO = r"\bPO\s*[-–— ]\s*\d{4}\s*[-–— ]\s*\d{3,6}\b"


def document_currency(lines: Column) -> Column:
    """The one currency code printed in a document's lines (an array of texts), or null if there is none or several."""
    codes = F.array_distinct(F.flatten(F.transform(lines, lambda t: F.transform(_all(t, rf"(?iu){_T_CODE}", 0), F.upper))))
    return F.when(F.size(codes) == 1, F.get(codes, F.lit(0)))


def line_currency(c: Column, document: Column) -> Column:
    """The currency that a line's amounts are in: its own code, or its own sign that names one, or the document's where it has an ambiguous sign."""
    found = _all(c, _T_CURRENCY, 0)
    code = F.get(F.filter(found, lambda t: t.rlike("^[A-Za-z]{3}$")), F.lit(0))
    sign = F.get(found, F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in {"€": "EUR", "£": "GBP", "R$": "BRL", "MX$": "MXN"}.items() for x in kv])
    return F.coalesce(F.upper(code), F.try_element_at(known, F.upper(sign)), F.when(c.rlike(r"[$¥]|Fr"), document))


def tolerant_candidates(c: Column, document: Column) -> Column:
    """Array of (field, value) for the ten fields of a line by the tolerant profile, values as printed; document: the currency of ``document_currency``.

    Orders may be misshapen behind a label; a date is the rest of its line up to an order's label; all tax rates of a line are given, also
    contradicting ones; a dollar sign is a candidate only where no currency is known, as what can't be read.
    """
    own = line_currency(c, document)
    v = {
        "currency": F.concat(_all(c, _T_CURRENCY, 0), F.when(own.isNull(), _all(c, r"(?<![A-Z0-9])\$(?![A-Z0-9])", 0)).otherwise(F.array().cast("array<string>"))),
        "invoice_number": F.filter(_all(c, rf"(?iu){_T_INVOICE}\s*[:#.]?\s*([A-Z0-9][A-Z0-9/_-]{{2,}})", 1), lambda t: ~t.rlike(r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}$")),
        "order": F.concat(_all(c, f"(?iu){_T_PO}", 0), F.filter(_all(c, rf"(?iu){_T_ORDER}\s*[:#.]?\s*(PO[^\s,;]{{0,20}})", 1), lambda t: ~t.rlike(f"(?iu)^(?:{_T_PO})$"))),
        "tax_rate": _all(c, r"(?iu)(\d{1,2}(?:[.,]\d{1,2})?)\s*%\s*(?:[A-Za-zÀ-ÿ]+\s+){0,3}(?:VAT|TVA|IVA|MWST|TAX)\b", 1),
    }
    first = lambda pattern: F.array_compact(F.array(F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))))
    v["date"] = F.transform(first(rf"(?iu){_T_DATE}\s*[:.]?\s*(.+)$"), lambda t: F.trim(F.regexp_replace(t, rf"(?iu)\s+{_T_ORDER}\b.*$", "")))
    v["supplier_nif"] = F.when(c.rlike(_T_CLIENT), F.array().cast("array<string>")).otherwise(first(rf"(?iu){_T_TAX_ID}\s*[:.]?\s*([A-Z0-9./-]{{8,24}})"))
    v["iban"] = F.when(c.rlike(r"(?iu)\biban\b|cuenta\s+(?:de\s+)?abono"), _all(c, r"(?iu)\b([A-Z]{2}\s*\d{2}(?:\s*[A-Z0-9]){11,30})\b", 1)).otherwise(F.array().cast("array<string>"))
    return F.concat(*[_named(f, x) for f, x in v.items()], _amounts(c, own == "JPY"))


FAMILIES = {
    "pay_unchecked": [
        "no procede contrastarlo", "no es necesario", "sin necesidad de", "ignorar la discrepancia", "ya esta aprobada", "ya ha sido verificad", "ya realizada por el responsable", "autorizada por la administracion",
        "autorizada por el ceo", "autorizado por el ceo", "autorizada en regimen especial", "no recalcular", "registrar como pagar", "diferencia de importe autorizada",
    ],
    "do_not_pay": ["no procede pago", "solo a efectos de archivo", "unicamente a efectos contables"],
    "escalate": [
        "excluirse del calculo de precision", "excluirse del computo de aciertos", "conjunto de test", "equipo de evaluacion", "auditor de calidad", "documento de prueba remitido", "debe marcarse como escalado",
        "debe marcarse como escalar",
    ],
    "to_system": ["los sistemas automaticos", "sistemas de validacion automatica", "sin escalado adicional", "continuar el pago sin escalado", "no bloquear validacion", "pago inmediato requerido", "aviso interno"],
}


def families(c: Column) -> dict[str, Column]:
    """Whether a text, folded, holds a phrase of each family of manipulation."""
    return {k: fold(c).rlike("|".join(words)) for k, words in FAMILIES.items()}


# What an instruction to a machine looks like.
_ORDERS = (
    r"(?iu)agente|ignora[rd]?|no\s+registres|hardcode|equipo\s+de\s+evaluaci[oó]n|no\s+recalcular|debe\s+marcarse|ignore\s+(?:all|previous|the|prior)|system\s*(?:message|prompt|:)"
    r"|mark\s+(?:as\s+)?(?:PAGAR|NO_PAGAR|paid)|do\s+not\s+(?:log|record)|<\s*script\b|\b(?:curl|wget)\s+https?://|\b(?:execute|ejecuta)\b"
)


def gives_orders(c: Column) -> Column:
    """Whether a text gives orders to who reads it; null for null."""
    return c.rlike(_ORDERS)


def without_bare_dollar(marks: Column) -> Column:
    """An array of currency marks without bare dollars, if a code of three letters is among them."""
    return F.when(F.exists(marks, lambda m: m.rlike("^[A-Za-z]{3}$")), F.filter(marks, lambda m: m != "$")).otherwise(marks)
