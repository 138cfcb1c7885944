"""Fixed values of the invoice domain: enums, rate sets, weights, word lists and patterns.

These are data, not logic.  Patterns are Java regular expressions; ``(?iU)`` gives case folding and
character classes over the whole of Unicode.
"""

# --- fixed values: state machines and enums --------------------------------------------------------
INVOICE_STATES = (
    "SUBIDA", "EN_PROCESO", "PROCESADA_IA", "PENDIENTE_REVISION",
    "VALIDADA", "RECHAZADA", "SINCRONIZADA", "ERROR_PROCESAMIENTO",
)
JOB_STATES = ("PENDIENTE", "EN_PROCESO", "COMPLETADO", "ERROR")
USER_ROLES = ("ADMIN", "CONTABILIDAD", "REVISOR", "LECTURA", "EMPRESA_UPLOAD")
CHANNELS = ("web", "mobile_camera", "mobile_gallery")

EDITABLE_STATES = ("PENDIENTE_REVISION", "PROCESADA_IA", "RECHAZADA")
ACTIONABLE_STATES = ("PENDIENTE_REVISION", "PROCESADA_IA")
REPROCESSABLE_STATES = ("PENDIENTE_REVISION", "PROCESADA_IA", "ERROR_PROCESAMIENTO", "RECHAZADA")
ACTIVE_STATES = ("SUBIDA", "EN_PROCESO")
LIST_NOT_REPROCESSABLE = ("SUBIDA", "EN_PROCESO", "VALIDADA", "SINCRONIZADA")

# state reached by an audit action; actions outside this table leave the state alone
ACTION_STATE = {
    "SUBIDA": "SUBIDA",
    "PROCESAMIENTO_INICIADO": "EN_PROCESO",
    "PROCESADA_IA": "PENDIENTE_REVISION",
    "ERROR_PROCESAMIENTO": "ERROR_PROCESAMIENTO",
    "VALIDADA": "VALIDADA",
    "RECHAZADA": "RECHAZADA",
    "REPROCESO_SOLICITADO": "SUBIDA",
}
# action -> (roles that may do it, whether EMPRESA users are barred)
ACTION_PERMISSIONS = {
    "SUBIDA": (("ADMIN", "CONTABILIDAD", "EMPRESA_UPLOAD"), False),
    "EDITADA": (("ADMIN", "CONTABILIDAD", "REVISOR"), True),
    "VALIDADA": (("ADMIN", "CONTABILIDAD", "REVISOR"), True),
    "RECHAZADA": (("ADMIN", "CONTABILIDAD", "REVISOR"), True),
    "REPROCESO_SOLICITADO": (("ADMIN", "CONTABILIDAD", "REVISOR"), True),
}

# --- fixed values: admission limits ----------------------------------------------------------------
ALLOWED_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tiff", "tif", "webp")
ALLOWED_MIME = ("application/pdf", "image/jpeg", "image/png", "image/tiff", "image/webp")
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_ENGINE_BYTES = 50 * 1024 * 1024
MAX_FILES_PER_REQUEST = 25
#: Pages of a document that are read; what lies behind them is left out with a warning.
MAX_PAGES = 8

# --- fixed values: processing ----------------------------------------------------------------------
STALE_MINUTES = 15
MAX_RECOVERIES = 2
REQUEUE_MESSAGE = "Job reencolado automaticamente tras quedar atascado"
GIVE_UP_MESSAGE = "Job marcado como error tras multiples recuperaciones automaticas"
BILLING_MILESTONES = (50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000)
SCALE_OUT_PER_MINUTE = 50
UPLOADS_PER_HOUR = 30
LOGINS_PER_15_MIN = 5
USD_PER_MILLION_IN = "0.25"
USD_PER_MILLION_OUT = "2.00"

# --- fixed values: indirect tax rates, percent ------------------------------------------------------
IVA_RATES = (4.0, 10.0, 21.0)
IGIC_RATES = (0.0, 3.0, 5.0, 7.0, 9.5, 15.0)
WITHHOLDING_RATES = (7.0, 15.0, 19.0, 21.0)

# --- fixed values: confidence ----------------------------------------------------------------------
WEIGHTS_ABSENT_ZERO = {
    "numero_factura": "0.12", "fecha": "0.12", "entities": "0.15", "base_imponible": "0.18",
    "iva_porcentaje": "0.05", "iva": "0.10", "total": "0.18", "proveedor": "0.03",
    "cif_proveedor": "0.03", "cliente": "0.02", "cif_cliente": "0.02",
}
WEIGHTS_ABSENT_SKIPPED = {
    "numero_factura": "1.5", "fecha": "1.5", "proveedor": "1.2", "cif_proveedor": "1.3",
    "cliente": "0.8", "cif_cliente": "0.8", "base_imponible": "1.5", "iva": "1.0",
    "iva_porcentaje": "0.7", "total": "1.8", "lineas": "1.0",
}
CRITICAL_FIELDS = ("numero_factura", "fecha", "total", "base_imponible")
CONFIDENCE_CAP = "0.97"
FILLABLE_FIELDS = (
    "numero_factura", "fecha", "base_imponible", "iva_porcentaje", "iva", "total", "proveedor",
    "cif_proveedor", "cliente", "cif_cliente", "retencion_porcentaje", "retencion",
)
TICKET_OPTIONAL_FIELDS = ("cliente", "cif_cliente", "base_imponible", "iva_porcentaje", "iva")
TICKET_TYPES = ("ticket", "factura_simplificada")

# --- fixed values: tax ids -------------------------------------------------------------------------
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CIF_CONTROL_LETTERS = "JABCDEFGHI"
CIF_FORMAT = r"^[A-HJ-NP-SUVW][0-9]{7}[0-9A-J]$"
NIF_FORMAT = r"^[0-9]{8}[A-Z]$"
NIE_FORMAT = r"^[XYZ][0-9]{7}[A-Z]$"
CIF_CHECKED_FORMAT = r"^[A-HJ-NP-SUVW][0-9]{7}[A-Z0-9]$"
LOOSE_ID_FORMAT = r"^[A-Z][0-9]{7}[A-Z0-9]$"
ANY_TAX_ID = (
    r"(?iU)\b(?:[A-HJ-NP-SUVW][\s.\-]*(?:\d[\s.\-]*){7}[0-9A-J]|"
    r"\d{8}\s*[A-Z]|"
    r"[XYZ][\s.\-]*(?:\d[\s.\-]*){7}[A-Z])\b"
)

# --- fixed values: names ---------------------------------------------------------------------------
COMPANY_SUFFIXES = r"\b(?:S\.?L\.?U?\.?|S\.?A\.?U?\.?|S\.?C\.?|C\.?B\.?)\b"
GENERIC_PARTY_NAMES = ("CLIENTE", "PROVEEDOR", "EMISOR", "FACTURA", "DES", "MONTES")
NAME_SUFFIX_BONUS = r"(?iU)\b(?:S\.?L\.?U?\.?|S\.?A\.?|C\.?B\.?|S\.?C\.?\s*(?:PROFESIONAL)?|SOCIEDAD)\b"
SHORT_SUFFIX = r"(?iU)\b(?:S\.?L|S\.?A|C\.?B)\b"
TERMS_NOT_NAMES = (
    r"(?iU)\b(?:factura|fecha|total|base|importe|p[aá]gina|datos|condiciones|"
    r"entrada|responsable|vencimiento|domiciliaci|transferencia|"
    r"forma\s+de\s+pago|concepto|observaciones|n[uú]mero|referencia|ref\b|"
    r"c[oó]d(?:igo)?\.?\s+de|art[ií]culo|descripci[oó]n|cantidad|precio|descuento|"
    r"plazo|cuenta|iban|pedido|albar[aá]n|portes|env[ií]o|recargo|"
    r"bonificaci[oó]n|retenci[oó]n|irpf|subtotal|cuota|"
    r"centro|vend(?:edor)?|documento|mesa|camarero|"
    r"consulta|borrador|no\s+valido|"
    r"CIF|NIF|DNI|C\.I\.F|N\.I\.F|partida|part\.\s*n|ficha)\b"
)
PLACES = (
    r"(?iU)^(?:LAS\s+PALMAS(?:\s+DE\s+G(?:RAN)?\s*\.?\s*C(?:ANARIA)?\.?)?|TENERIFE|GRAN\s+CANARIA|"
    r"LANZAROTE|FUERTEVENTURA|LA\s+PALMA|LA\s+GOMERA|EL\s+HIERRO|"
    r"MADRID|BARCELONA|SEVILLA|VALENCIA|MALAGA|MURCIA|ALICANTE|"
    r"ZARAGOZA|BILBAO|VIGO|CADIZ|CORDOBA|GRANADA|TOLEDO|"
    r"SANTA\s+CRUZ(?:\s+DE\s+TENERIFE)?|CANARIAS|ISLAS\s+CANARIAS|"
    r"ESPA[ÑN]A|SPAIN)\s*$"
)
LABEL_ONLY = (
    r"(?iU)^(?:Firma|Sello|Firma/Sello|Datos\s+de|Tel[éef]fono|Direcci[oó]n|"
    r"P[áa]gina|Importe|Total|Base|Factura|Fecha|Concepto|Observaciones|"
    r"Forma\s+de\s+pago|Cuenta|IBAN|Referencia|Pedido|Albar[áa]n|"
    r"Mail|Web|Correo|Email|Tlf|Fax|M[óo]vil|"
    r"Entrega\s+de\s+mercanc[íi]a|Condiciones|Portes|Env[íi]o|Dto|"
    r"Descuento|Bonificaci[óo]n|Recargo|Vencimiento|Plazo|"
    r"Unidades|Cantidad|Precio|Art[íi]culo|C[óo]digo)\s*:?\s*$"
)
# a line that matches any of these cannot be the name of a party; with each pattern, the character that
# every match contains, where there is one
NOT_A_NAME = (
    (r"(?U)^[\d\s\-+().]+$", ""),
    (r"(?U)^.*@.*\.", "@"),
    (r"(?U)^\d{5}\b", ""),
    (r"(?iU)^(?:www\.|https?://)", ""),
    (r"(?iU)^(?:CL?/|AVDA\.?\s|CALLE\s|PZZA?\.?\s|PLAZA\s|PASEO\s|CTRA\.?\s|URB\.?\s)", ""),
    (r"(?U)^[^\d:][^:]{1,35}:\s+\S", ":"),
    (r"(?U)\d{1,2}/\d{1,2}/\d{2,4}", "/"),
    (r"(?iU)(?:www\.|https?://|\.com|\.es)", ""),
    (r"(?iU)\d+\s*(?:GB|MB|TB|GHZ|MHZ|W\d|/\d)", ""),
    (TERMS_NOT_NAMES, ""),
    (r"(?U)^.{2,30}:\s*$", ":"),
    (PLACES, ""),
    (LABEL_ONLY, ""),
)

# --- fixed values: invoice identity ----------------------------------------------------------------
INVOICE_NUMBER = (
    r"(?iU)(?:n[°ºo.\s]*(?:de\s+)?factura|factura\s*(?:n[°ºo.]?\s*)?|fra\.?\s*n?[°ºo.]?\s*|"
    r"n[°º]?\s*factura|invoice\s*(?:no?\.?\s*)?|factura\s*:)"
    r"\s*[:.]?\s*([A-Z0-9][\w\-/. ]{1,30}[A-Z0-9])"
)
INVOICE_CODE = r"(?U)^([A-Z]{1,4}[\-/]?\d{4,}(?:[\-/]\d+)*)\b"
NUMBER_LABELS = (
    "n factura", "numero factura", "numero de factura", "n de factura", "fra", "invoice",
    "num factura", "no factura", "factura n", "factura num", "factura no", "factura numero", "numero",
)
NUMBER_BLACKLIST = (
    r"(?iU)^(?:DOCUMENTO|PAGINA|P[ÁA]GINA|TOTAL|FACTURA|FECHA|CLIENTE|PROVEEDOR|"
    r"EMISOR|RECEPTOR|DESTINATARIO|IMPORTE|SUBTOTAL|BASE|IVA|IGIC|IRPF|"
    r"CUOTA|RETENCI[ÓO]N|DATOS|VENTA|COMPRA|TIPO|CONCEPTO|DESCRIPCI[ÓO]N|"
    r"OBSERVACIONES|FORMA\s+DE\s+PAGO|CUENTA)\b"
)
PAGE_REFERENCE = r"(?iU)P[áa]gina\s+\d+\s+de\s+\d+"
NUMBER_NOISE_TAIL = r"(?iU)\s+(?:FECHA|HORA|IMPORTE|TOTAL|PAGINA|PAGE)\s*$"
RECTIFIED_NUMBER = (
    r"(?iU)(?:factura\s+(?:rectificada|original|que\s+se\s+rectifica))\s*:?\s*([A-Z0-9][\w\-/. ]+)"
)
RECTIFIED_LABELS = (
    "factura rectificada", "factura original", "rectifica a", "factura que se rectifica",
)
TICKET_MARKERS = (
    r"(?iU)\b(?:DOCUMENTO\s+DE\s+VENTA|TICKET|NO\s+VALIDO\s+COMO\s+FACTURA|TOTAL\s+COMPRA|"
    r"FACTURA\s+SIMPLIFICADA|FRA\.?\s+SIMPLIFICADA)\b"
)
RECTIFYING_MARKERS = r"(?iU)\b(?:RECTIFICAT|ABONO|FACTURA\s+RECTIFICATIVA|FACTURA\s+ABONO)\b"

# --- fixed values: dates ---------------------------------------------------------------------------
DATE_LABELS = (
    "fecha", "fecha factura", "fecha de factura", "fecha emision",
    "fecha de emision", "fecha expedicion", "date", "fecha de expedicion",
)
DATE_BARE = r"(?U)\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"
DATE_PREFIX = r"(?U)^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
DATE_LABELLED = (
    r"(?iU)(?:fecha(?:\s+de)?(?:\s+(?:factura|emisi[oó]n|expedici[oó]n))?|date)\s*:?\s*"
    r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
)
MONTHS_ES = (
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
)
DATE_LONG_ES = r"(?iU)(\d{1,2})\s+de\s+(" + "|".join(MONTHS_ES) + r")\s+(?:de\s+)?(\d{4})"

# --- fixed values: fields and amounts --------------------------------------------------------------
LABEL_VALUE = r"(?U)^([A-ZÁÉÍÓÚÑa-záéíóúñ][A-ZÁÉÍÓÚÑa-záéíóúñ\s.°º/]{2,40}?)\s*[:]\s*(.+)$"
STANDALONE_LABEL = (
    r"(?iU)^(FACTURA|FECHA|TOTAL|BASE(?:\s+IMPONIBLE)?|IVA|IGIC|SUBTOTAL|"
    r"CUOTA|RETENCI[ÓO]N|IRPF|PROVEEDOR|CLIENTE|EMISOR|DESTINATARIO|"
    r"N[°ºO.]\s*FACTURA|NUMERO\s+FACTURA|CIF|NIF|%\s*(?:IVA|IGIC)|IMPORTE|"
    r"DATOS\s+(?:DEL?\s+)?(?:PROVEEDOR|CLIENTE|EMISOR|DESTINATARIO))$"
)
AMOUNT = r"-?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})|-?\d+(?:[.,]\d{2})"
PERCENT = r"(-?\d+(?:[.,]\d{1,2})?)\s*%"
METADATA_LINE = r"(?U)\b(?:CIF|NIF|DNI|TEL|FAX|MOVIL|CORREO|EMAIL|REF|PEDIDO|ALBARAN)\b"
LABEL_BASE = r"\b(?:base\s+imponible|importe\s+neto|subtotal|base)\b"
LABEL_TAX = r"\b(?:cuota\s+(?:iva|igic)|iva|igic)\b"
LABEL_TOTAL = r"\b(?:total(?:\s+factura|\s+compra)?|importe\s+total)\b"
LABEL_WITHHOLDING = r"\b(?:retenci[oó]n|irpf)\b"
WITHHOLDING_IN_TEXT = r"(?iU)retenci[oó]n.*?(\d{1,2}(?:[.,]\d+)?)\s*%.*?(\d+[.,]\d{2})"

# --- fixed values: line-item table -----------------------------------------------------------------
HEADER_SPAN = 12
DESCRIPTION_WORD = r"(?iU)\b(?:CONCEPTO|DESCRIPCI[ÓO]N|DETALLE|ART[ÍI]CULO|SERVICIO)\b"
AMOUNT_WORD = r"(?iU)\b(?:IMPORTE|PRECIO|TOTAL|NETO|CANTIDAD|CANT|UDS|UND|UNIDADES?|VALOR)\b"
HEADER_WORD = (
    r"(?iU)\b(?:CONCEPTO|DESCRIPCI[ÓO]N|DETALLE|ART[ÍI]CULO|SERVICIO|REFERENCIA|"
    r"IMPORTE|PRECIO|TOTAL|NETO|CANTIDAD|CANT|UDS|UND|UNIDADES?|UNIT(?:ARIO)?|"
    r"SUBTOTAL|DTO|DESCUENTO|BASE|I[GV][AI]C|VALOR|COD\.?|REF\.?)\b"
)
FOOTER_WORD = (
    r"(?iU)\b(?:BASE\s+IMPONIBLE|SUBTOTAL|TOTAL\b|"
    r"IVA\b|I\.?G\.?I\.?C\.?\b|CUOTA|RETENCI|IRPF|"
    r"FORMA\s+(?:DE\s+)?PAGO|CONDICIONES|OBSERVACIONES|NOTA\b|"
    r"VENCIMIENTO|DESGLOSE\s+IMPUESTO|TRANSFERENCIA|IBAN|CUENTA|"
    r"GRACIAS\s+POR|SUMA\s+TOTAL)\b"
)
NUMBER_LINE = r"(?U)^\s*[−–\-]?\d[\d.,]*\s*€?\s*$"
RULE_LINE = r"(?U)^[\-|:\s]+$"
QUANTITY_PREFIX = r"(?U)^(\d+)\s+(?:[xX×]\s+)?(.+)$"
PERCENT_ONLY = r"(?U)^\d+(?:[.,]\d+)?\s*%$"
INLINE_ITEM = r"(?U)^(.+?)\s{2,}(-?\d[\d.,]*)\s*€?\s*$"
TRAILING_NUMBER = r"(?U)\d[\d.,]+\s*€?\s*$"

# --- fixed values: warning codes -> group, first rule that fits wins --------------------------------
WARNING_PREFIX_GROUPS = (
    ("doc_ai_fallback_error", "doc_ai_fallback_error"),
    ("doc_ai_fallback", "doc_ai_fallback"),
    ("discrepancia_", "source_discrepancy"),
    ("familia_ticket_", "ticket_interpretation"),
    ("familia_shipping_billing_", "document_role_adjustment"),
    ("familia_company_sale_", "document_role_adjustment"),
    ("familia_rectificativa_", "document_role_adjustment"),
    ("lineas_", "line_item_adjustment"),
    ("linea_unica_", "line_item_adjustment"),
    ("base_", "amount_adjustment"),
    ("iva_", "amount_adjustment"),
    ("total_", "amount_adjustment"),
    ("importes_", "amount_adjustment"),
    ("retencion_", "withholding_adjustment"),
    ("proveedor_", "party_adjustment"),
    ("cliente_", "party_adjustment"),
    ("numero_factura_", "identity_adjustment"),
)
NUMBERED_LINE_CODE = r"^linea_[0-9]+_"
REGION_RESCUE_CODE = "region_hint_rescue_applied"
ADJUSTMENT_GROUPS = (
    "amount_adjustment", "line_item_adjustment", "party_adjustment", "document_role_adjustment",
)

# --- fixed values: review messages -----------------------------------------------------------------
MSG_JOB_ERROR = "El proceso automatico registro un error: "
MSG_FALLBACK = (
    "La lectura automatica utilizo una via complementaria selectiva para cerrar la interpretacion "
    "del documento. Conviene revisar los campos clave antes de validar."
)
MSG_FALLBACK_ERROR = (
    "La via complementaria selectiva no estuvo disponible durante parte del proceso. Se ha mantenido "
    "la mejor lectura principal disponible."
)
MSG_NO_NUMBER = "Falta el numero de factura."
MSG_NO_DATE = "Falta la fecha de la factura."
MSG_NO_PARTY = "Falta identificar la contraparte principal del documento."
MSG_NO_TAX_ID = "No se ha podido confirmar el NIF/CIF de la contraparte."
MSG_BAD_TAX_ID = "El NIF/CIF de la contraparte no se ha podido validar con suficiente fiabilidad: %s."
MSG_TOTALS = (
    "Los importes no cuadran todavia: base (%s) + %s (%s) no coincide con el total (%s)."
)
MSG_LINES = "La suma de lineas (%s) no coincide con la base imponible (%s)."
MSG_NO_LINES = (
    "No se han detectado lineas de detalle. Puedes completarlas manualmente si te hacen falta."
)
MSG_RECONCILED = (
    "El documento presento diferencias entre lecturas alternativas, pero el resultado final ya se ha "
    "reconciliado con la opcion mas coherente."
)
MSG_ADJUSTED = (
    "Se han aplicado ajustes automaticos sobre el detalle del documento y el resultado final ya es "
    "coherente con los importes detectados."
)
MSG_TICKET = (
    "El documento se ha tratado como ticket o factura simplificada. En este tipo de justificantes es "
    "normal que algunos datos fiscales o del cliente no aparezcan completos."
)

# --- fixed values: marks that recognisers put into page text ---------------------------------------
MARKDOWN_MARKS = (
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*{1,3}(.+?)\*{1,3}", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
)
MARKDOWN_RULE = r"^[-*_]{3,}\s*$"
TABLE_RULE = r"^\|\s*[-:\s|]+\|?$"
EMPTY_CELL = "---"

# --- fixed values: labels and marks around a name --------------------------------------------------
ID_LABEL_ANY = r"(?iU)[CND]\.?[IN]\.?[FI]"
ID_LABEL_HEAD = r"(?iU)^(?:CIF|NIF|DNI|N\.?I\.?F\.?|C\.?I\.?F\.?)\s*:?\s*"
ID_LABEL_TAIL = r"(?iU)\s*(?:CIF|NIF|DNI)\s*:?\s*$"
NAME_MARKS = (
    (r"^#{1,6}\s*", ""),
    (r"\*{1,3}(.+?)\*{1,3}", "$1"),
    (r"^\(\d+\)\s*", ""),
)
