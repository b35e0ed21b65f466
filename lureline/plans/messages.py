"""The message, turn and page views over the given tables.

The given documents hold no scam wording, so each document is carried into a message by joining a small table of
phrases on ``doc_id`` modulo the table's length. Every document takes part, with its whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("phrase", "source_url", "claimed_company", "claimed_domain", "recruiter_email", "claimed_license", "country_code", "expected_rule")

# phrase, link, company, domain, e-mail, licence, country, the rule it is meant to meet (None: none).
PHRASES: tuple[tuple[str | None, ...], ...] = (
    (None, None, None, None, None, None, None, None),
    ("Please pay the onboarding fee today, then your start date for the remote role is fixed.", "http://career-support.top/official/login", "Quillfen Ltd", "quillfen.com", "hr.quillfen@gmail.com", None, "sg", "job_upfront_fee"),
    ("Recharge your wallet so the next batch of tasks opens and your commission is kept.", "https://bit.ly/q-91", None, None, None, None, "US", "task_deposit"),
    ("Rate hotel listings and earn 90 a day as commission, no skills asked.", None, None, None, "team@worktasks.xyz", None, " gb ", "social_boosting"),
    ("The wallet shows a negative amount, top up to continue with the set.", None, None, None, None, None, "AU", "negative_balance"),
    ("There was an error in the third order, you have to pay to rectify it.", None, None, None, None, None, None, "task_mistake"),
    ("Activate the VIP tier and the daily limit grows once the fee is in.", "https://vip.tier.club-north.vip/claim-secure", None, None, None, None, "MY", "account_upgrade"),
    ("Advance the money for customer orders of your new online store.", None, None, None, None, None, None, "fake_shop_funding"),
    ("Collect the cash from the lady and bring it to our courier.", None, None, None, None, None, "IN", "physical_cash"),
    ("Your first test withdrawal of 40 was credited, see, it works.", None, None, None, None, None, None, "small_payout"),
    ("In the Telegram channel everyone posts a profit screenshot by noon.", "https://telegram-jobs.work/join", None, None, None, None, None, "group_testimonials"),
    ("Backed by a well known minister, this platform pays out each Friday.", None, None, None, None, None, "CA", "celebrity_endorsement"),
    ("Download the APK from the link I sent, it is not in the store yet, and allow unknown sources.", "http://203.0.113.9/app.apk", None, None, None, None, None, "sideload_app"),
    ("You receive parcels at home and forward them to a new address abroad.", None, None, None, None, None, "US", "reshipping"),
    ("Let us use your bank account to collect client transfers, keep 8 percent.", None, None, None, None, None, None, "money_mule"),
    ("Deposit our cheque, buy the laptop from our vendor and wire the rest.", None, "Ostrava Tools", "ostrava-tools.example", "jobs@ostrava-tools.example", "LIC-204", "CZ", "fake_cheque"),
    ("Send a photo of your passport and the OTP you get, for our files.", None, None, None, None, None, "SG", "sensitive_data"),
    ("Reply on WhatsApp, the hiring desk is online now.", None, None, None, "recruit@hotmail.com", None, None, "chat_recruitment"),
    ("You are selected without any interview, immediate hire.", None, None, "meridor.org", "anna@meridor.org", None, "US", "no_interview"),
    ("Assured monthly profit for every member, risk free.", "https://dbs-secure.com/verify-official", "DBS", "dbs.com", "desk@dbs-secure.com", "MAS-77", "SG", "guaranteed_returns"),
    ("Make $900 each day, overnight if you like, double your money in a week.", "https://binnance.com/bonus/support", None, None, None, None, None, "unrealistic_return"),
    ("Settle the release tax first and the withdrawal is yours.", "https://user:pass@pay.example.com/x", None, None, None, None, "GB", "withdrawal_fee"),
    ("Join now, limited slots, last chance.", None, None, None, None, None, None, "pressure"),
    ("Transfer 300 in USDT to wallet address 0x52908400098527886E0F7030069857D2E4169EE7 please.", None, None, None, None, None, None, "unusual_payment"),
    ("Invite friends and every member brings you a bonus.", None, None, None, None, None, "PH", "referral_income"),
    ("Market research pays 20 a form, a deposit unlocks the next questionnaire.", None, None, None, None, None, None, "survey_deposit"),
    ("The agency needs a refundable deposit to issue the contract.", None, "Fenwick Staffing", "fenwick.co.uk", "offers@fenwick-staffing.co.uk", None, "GB", "job_recruiter_deposit"),
    ("Order the headset from our approved vendor, finance will reimburse you.", None, None, None, None, None, None, "job_assigned_supplier"),
    ("We have switched to a new bank account, disregard the earlier invoice details.", None, None, None, None, None, None, "payment_instruction_change"),
    ("Log in with your email password to see the payroll form.", "https://xn--mnchen-3ya.example.net/login", None, None, None, None, None, "credential_request"),
    ("Connect your wallet and approve the spending limit.", "https://claim.reward.airdrop.sign.wallet-official.click/a", None, None, None, None, None, "wallet_approval"),
    ("We traced the coins you lost; pay the file fee upfront and they come back.", None, None, None, None, None, None, "recovery_fee"),
    ("Buy the low-cap coin at three and hold until the admins call the sell signal.", None, None, None, None, None, None, "pump_group"),
    ("An escrow payment is due prior to release of the grant.", None, None, None, None, None, "NG", "grant_release_fee"),
    ("The regulator says you must transfer 2,000 to the clearance desk.", None, None, None, None, None, None, "regulator_payment_demand"),
    ("Scam awareness: fraudsters ask you to pay a training fee before you start work. Our firm never does.", None, None, None, None, None, "SG", None),
    ("Reminder: never share an OTP or your passport with a stranger. Call 1800 555 0199 or +65 6123 4567.", None, None, "sgbank.com.sg", "help@sgbank.com.sg", None, "SG", None),
    ("Returns are not guaranteed; all investments carry risk.", None, None, None, None, None, None, None),
    ("Refer a colleague who joins our team and completes 6 months to get the referral bonus.", None, None, None, None, None, None, None),
    ("P4y the v i s a fee for this j0b (dot) write to desk[at]quick-hire[.]top or hxxps://quick-hire[.]top/job", None, None, None, None, None, None, "job_upfront_fee"),
    ("Ｇｕａｒａｎｔｅｅｄ pr0fit, ze​ro risk, соntact @fast_gain_01", None, None, None, None, None, None, "guaranteed_returns"),
    ("Para el puesto debes pagar la tasa de 150 EUR con tu oferta de trabajo.", None, None, None, None, None, "ES", "es_job_fee"),
    ("Votre solde est négatif, rechargez pour débloquer les tâches avec les autres.", None, None, None, None, None, "FR", "fr_task_topup"),
    ("Para fazer o saque você paga a taxa de 15% hoje, não demora.", None, None, None, None, None, "BR", "pt_withdraw_fee"),
    ("Wir bieten die garantierte Rendite mit null Risiko und ohne Stress auf das Konto.", None, None, None, None, None, "DE", "de_guaranteed"),
    ("Bạn cần nạp 500 USDT để kích hoạt nhiệm vụ, sau đó tiền được hoàn lại cho bạn.", None, None, None, None, None, "VN", "vi_task_deposit"),
    ("Garantisado ang tubo ng puhunan mo, kada araw may balik sa iyo.", None, None, None, None, None, "PH", "tl_guaranteed"),
    ("नौकरी के लिए ₹500 शुल्क का भुगतान करें।", None, None, None, None, None, "IN", "hi_job_fee"),
    ("ارباح مضمونة من الاستثمار بدون مخاطر.", None, None, None, None, None, "AE", "ar_guaranteed"),
    ("ลงทุนกับเรา การันตีกำไรทุกวัน", None, None, None, None, None, "TH", "th_guaranteed"),
    ("Nunca pedimos dinero: no pagues ninguna tasa de 150 EUR por una oferta de trabajo, es una estafa.", None, None, None, None, None, "MX", None),
    ("保证每天收益，零风险。", None, None, None, None, None, "CN", "zh_guarantee"),
    ("Untung dijamin tanpa risiko, hubungi kami.", None, None, None, None, None, "ID", "ms_guarantee"),
    ("உறுதியான லாபம் கிடைக்கும்.", None, None, None, None, None, "LK", "ta_guarantee"),
    ("Это обычное письмо о встрече в понедельник, деньги не нужны.", None, None, None, None, None, "RU", None),
    ("Send it to 1BoatSLRHtKNngkdXEeobR76b53LETtpyT or TJRabPrwbZy45sbavfcjinPJC18kjpRTv8, write @coin_desk.", "https://www.posb-help.com/claim", None, "posb.com.sg", "care@posb-help.com", None, "SG", None),
    ("Notice: the account shows a negative balance due to bank charges, the direct debit was returned.", None, None, None, None, None, "SG", None),
    ("The fund earned 12% a day at its best and 9% per year over the past five years; its track record is public.", None, None, None, None, None, "GB", None),
    ("Candidates pay no training fee for the job, we cover the cost of the course.", None, "Brookmere Care", "brookmere.example", "post@brookmere.example", None, "IE", None),
    ("Pay the training fee of the dance club at the door.", None, None, None, None, None, "DK", None),
)

# Turns: what is said at (conv_id * 5 + turn) modulo the length, so stages come in and out of order.
TURN_PHRASES: tuple[str | None, ...] = (
    None, "I am a recruiter and found your number.", "Just like and review a product, a simple task.", "The first small payout was credited to you.",
    "Now top up to reach the next set.", "The account is frozen and shows a negative balance.", "To withdraw you need to settle the tax.",
    None, "Thanks, see you on Monday.", "The recruiter asked for a deposit; the refund is pending behind a fee.",
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def phrases(spark: SparkSession) -> DataFrame:
    rows = [(i, *p) for i, p in enumerate(PHRASES)]
    return spark.createDataFrame(rows, "k int, " + ", ".join(f"{c} string" for c in COLUMNS))


def dealt(df: DataFrame, deal: int | None) -> DataFrame:
    """Rows dealt out evenly over `deal` tasks; None: as they are read.

    For tables that lie in fewer row groups than there are cores, since a task reads whole row groups. At scale files have many row groups,
    and it stays off: dealing shuffles the texts.
    """
    return df if deal is None else df.repartition(deal)


def message_view(spark: SparkSession, sf_dir: str, deal: int | None = None) -> DataFrame:
    """message_id, text, lang, source and the claims; one row per document. The phrase table is constant, so it is broadcast."""
    docs = dealt(read(spark, sf_dir, "documents"), deal).select(F.col("doc_id").alias("message_id"), F.col("text").alias("body"), "lang", "source")
    keyed = docs.withColumn("k", F.pmod("message_id", F.lit(len(PHRASES))).cast("int"))
    joined = keyed.join(F.broadcast(phrases(spark)), "k", "left")
    return joined.withColumn("text", F.concat_ws("\n", "body", "phrase")).drop("k", "body", "phrase")


def turn_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, sender, text."""
    turns = read(spark, sf_dir, "conversations")
    k = F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(len(TURN_PHRASES))).cast("int")
    said = F.element_at(F.array(*[F.lit(p) for p in TURN_PHRASES]), k + 1)
    return turns.select("conv_id", "turn", F.col("role").alias("sender"), F.concat_ws("\n", "text", said).alias("text"))


PAGE_SNIPPETS: tuple[str | None, ...] = (
    None,
    "<form action='/in'><input type='password' name='p'></form><p>Guaranteed daily profit for members</p>",
    "<p>Deposit 20 now to unlock the task set</p><p>Contact our Telegram support agent</p>",
    "<form></form><form></form><form><input type=\"text\"></form><p>Please install the apk file</p>",
    "<p>Our wallet address: send USDT, pay in crypto and deposit</p><img src=\"/a.png\">",
)


def page_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    k = F.pmod("page_id", F.lit(len(PAGE_SNIPPETS))).cast("int")
    more = F.element_at(F.array(*[F.lit(p) for p in PAGE_SNIPPETS]), k + 1)
    return pages.select("page_id", "url", F.concat_ws("", "html", more).alias("html"))
