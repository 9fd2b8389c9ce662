"""Rule-based retention actions.

The first matching rule decides the action:
1. satisfaction <= 5           → dissatisfaction
2. days since login > 15       → inactivity
3. transactions <= 3           → low activity
4. otherwise                   → proactive retention

Each action carries a reason, an offer, three templated messages and a
simulated reply, all built from ``Column`` expressions (``when`` chains and
``concat``), so the rules run inside the scan's codegen stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as X

# Rule thresholds.
MAX_SATISFACTION = 5
MAX_LOGIN_DAYS = 15
MAX_TRANSACTIONS = 3


@dataclass(frozen=True)
class Brand:
    """Names the message templates fill in (assistant, bank, loyalty programme, points)."""

    assistant: str = "tu asistente"
    bank: str = "tu banco"
    program: str = "Pro"
    points: str = "Puntos"


# Reason, offer, messages (with {placeholders}) and reply per rule,
# in rule order. {sat}, {login} and {estado} come from the client row.
ACTIONS = [
    {
        "motivo": "Insatisfacción Crítica",
        "mensajes": [
            "Hola, soy {assistant} de {bank}. 👋",
            "Noté que tu última evaluación de servicio fue de {sat}/10. Lamentamos mucho que tu experiencia no haya sido la mejor.",
            "Queremos compensarte. Te he bonificado la comisión de tu cuenta este mes y asigné un ejecutivo VIP a tu caso.",
        ],
        "oferta": "Bonificación + Ejecutivo VIP",
        "respuesta": "Muchas gracias, la verdad sí tuve un problema. Acepto la ayuda.",
    },
    {
        "motivo": "Inactividad Prolongada",
        "mensajes": [
            "¡Hola! Te extrañamos por acá. 🥺",
            "Vi que llevas {login} días sin usar tu app. Para que vuelvas a disfrutar tus beneficios en {estado}, te tengo una sorpresa.",
            "Tienes un 10% de Cashback extra en tu próxima compra pagando hoy con tu Tarjeta Virtual.",
        ],
        "oferta": "10% Cashback Adicional (24h)",
        "respuesta": "¡Wow! Gracias, justo iba a comprar algo hoy.",
    },
    {
        "motivo": "Baja Transaccionalidad",
        "mensajes": [
            "¡Hola! {assistant} por aquí. 🤖",
            "Vi que has hecho pocos movimientos este mes. Recuerda que estás a solo un par de compras de mantener tus beneficios {program}.",
            "Si realizas un pago de servicios desde la app hoy, te regalo 500 {points} de cortesía.",
        ],
        "oferta": "Bono de 500 {points}",
        "respuesta": "Súper, voy a pagar mi recibo de luz de una vez.",
    },
    {
        "motivo": "Retención Proactiva",
        "mensajes": [
            "¡Hola! Espero que estés teniendo un excelente día. 🌟",
            "En {bank} valoramos mucho tu lealtad. Analizando tu historial de uso, tengo una excelente noticia para ti.",
            "Tienes pre-aprobado un aumento automático en tu línea de crédito. ¡Acéptalo con un clic!",
        ],
        "oferta": "Aumento de Línea Pre-aprobado",
        "respuesta": "¡Increíble! Sí quiero el aumento.",
    },
]


def js_number_text(c: str | Column) -> Column:
    """A number as JavaScript prints it: whole values without a decimal part."""
    c = X.col_of(c)
    whole = c.cast("double") == F.floor(c.cast("double"))
    return F.when(whole, F.floor(c.cast("double")).cast("long").cast("string")).otherwise(c.cast("string"))


def _template(text: str, brand: Brand, values: dict[str, Column]) -> Column:
    """``concat`` of literal pieces and row values for a ``{placeholder}`` template."""
    text = (
        text.replace("{assistant}", brand.assistant)
        .replace("{bank}", brand.bank)
        .replace("{program}", brand.program)
        .replace("{points}", brand.points)
    )
    parts: list[Column] = []
    rest = text
    while "{" in rest:
        before, after = rest.split("{", 1)
        name, rest = after.split("}", 1)
        if before:
            parts.append(F.lit(before))
        parts.append(values[name])
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def rule_index(sat: Column, login: Column, txs: Column) -> Column:
    """0..3: the first rule that applies (null values never satisfy a rule)."""
    return (
        F.when(sat <= MAX_SATISFACTION, F.lit(0))
        .when(login > MAX_LOGIN_DAYS, F.lit(1))
        .when(txs <= MAX_TRANSACTIONS, F.lit(2))
        .otherwise(F.lit(3))
    )


def retention_actions(clients: DataFrame, brand: Brand = Brand()) -> DataFrame:
    """Action per client (X14) plus display rules.

    Input columns: user_id, estado, churn_score, satisfaccion_1_10,
    dias_desde_ultimo_login, total_tx, ingreso_mensual_mxn (a missing
    satisfaction, login or count reads as 0, as the list screen does).

    Output: user_id, estado, churn_score, nivel_score, satisfaccion_baja,
    ingreso_k, sugerencia, motivo, oferta, mensaje_1, mensaje_2, mensaje_3,
    respuesta.
    """
    sat = F.coalesce(F.col("satisfaccion_1_10").cast("double"), F.lit(0.0))
    login = F.coalesce(F.col("dias_desde_ultimo_login").cast("long"), F.lit(0).cast("long"))
    txs = F.coalesce(F.col("total_tx").cast("long"), F.lit(0).cast("long"))
    values = {
        "sat": js_number_text(sat),
        "login": login.cast("string"),
        "estado": F.coalesce(F.col("estado"), F.lit("")),
    }
    idx = rule_index(sat, login, txs)

    def pick(render) -> Column:
        expr = None
        for i, action in enumerate(ACTIONS):
            value = render(action)
            expr = F.when(idx == i, value) if expr is None else expr.when(idx == i, value)
        return expr

    return clients.select(
        "user_id",
        "estado",
        "churn_score",
        X.score_level("churn_score").alias("nivel_score"),
        X.low_satisfaction(sat).alias("satisfaccion_baja"),
        X.thousands_label(F.coalesce(F.col("ingreso_mensual_mxn"), F.lit(0.0))).alias("ingreso_k"),
        X.suggestion("churn_score").alias("sugerencia"),
        pick(lambda a: F.lit(a["motivo"])).alias("motivo"),
        pick(lambda a: _template(a["oferta"], brand, values)).alias("oferta"),
        *[pick(lambda a, k=k: _template(a["mensajes"][k], brand, values)).alias(f"mensaje_{k + 1}") for k in range(3)],
        pick(lambda a: F.lit(a["respuesta"])).alias("respuesta"),
    )


def action_messages(actions: DataFrame) -> DataFrame:
    """One row per message, in chat order: user_id, orden (1-3), mensaje."""
    return actions.select(
        "user_id",
        F.posexplode(F.array("mensaje_1", "mensaje_2", "mensaje_3")).alias("pos", "mensaje"),
    ).select("user_id", (F.col("pos") + 1).cast("long").alias("orden"), "mensaje")
