"""The starting watchlist and allowlist as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.sources import watchlist

# --- fixed values: name | slug | category | official domains | aliases | more terms | terms left out ---
BRANDS = """
State Bank of India | sbi | bank | sbi.co.in onlinesbi.sbi onlinesbi.com sbi.bank.in | sbi onlinesbi statebankofindia yonosbi | sbicard sbiyono yono |
HDFC Bank | hdfc-bank | bank | hdfcbank.com hdfcbank.net.in hdfcbank.bank.in | hdfc hdfcbank | hdfcnetbanking |
ICICI Bank | icici-bank | bank | icicibank.com icicibank.bank.in | icici icicibank | icicidirect | imobile
Axis Bank | axis-bank | bank | axisbank.com axisbank.bank.in | axisbank | | axis
Kotak Mahindra Bank | kotak | bank | kotak.com kotak.bank.in kotaksecurities.com | kotak kotakbank kotakmahindra | | kotakmahindrabank
Punjab National Bank | pnb | bank | pnbindia.in pnb.bank.in pnbnet.org.in | pnb pnbindia pnbnet | pnbnetbanking |
Bank of Baroda | bank-of-baroda | bank | bankofbaroda.in bankofbaroda.co.in bankofbaroda.bank.in bobibanking.com | bob bankofbaroda bobibanking | bobworld | bob
Canara Bank | canara-bank | bank | canarabank.com canarabank.bank.in | canara canarabank | canaranetbanking | canara
Union Bank of India | union-bank | bank | unionbankofindia.co.in unionbankonline.co.in unionbankofindia.bank.in | unionbankofindia unionbankonline | | union
Yes Bank | yes-bank | bank | yesbank.in | yesbank | |
IDFC First Bank | idfc-first | bank | idfcfirstbank.com idfcfirst.bank.in | idfc idfcfirst idfcfirstbank | |
IndusInd Bank | indusind | bank | indusind.com indusind.bank.in | indusind indusindbank | |
PhonePe | phonepe | payment | phonepe.com phon.pe | phonepe | | phon
Google Pay | google-pay | payment | pay.google.com google.com gpay.app | googlepay gpay | | google
Paytm | paytm | payment | paytm.com paytm.in paytmbank.com | paytm | paytmbank paytmkyc |
NPCI / UPI | npci-upi | payment | npci.org.in upichalega.com | npci upi | upipay upiid bharatupi | npciupi
RuPay | rupay | payment | rupay.co.in | rupay | |
BHIM | bhim | payment | bhimupi.org.in | bhim bhimupi | bhimapp |
Airtel Payments Bank | airtel-payments-bank | payment | airtelbank.com airtel.in | airtel airtelbank airtelpaymentsbank | airtelmoney airtelthanks |
Amazon Pay | amazon-pay | payment | amazonpay.in | amazonpay | | amazon
MobiKwik | mobikwik | payment | mobikwik.com | mobikwik | mobikwikwallet |
CRED | cred | payment | cred.club | cred credclub | credupi | cred
DigiLocker | digilocker | government | digilocker.gov.in digitallocker.gov.in | digilocker digitallocker | |
Income Tax e-Filing | income-tax | government | incometax.gov.in incometaxindia.gov.in incometaxindiaefiling.gov.in | incometax efiling | incometaxrefund itrfiling | efiling
UIDAI / Aadhaar | uidai-aadhaar | government | uidai.gov.in myaadhaar.uidai.gov.in | uidai aadhaar aadhar | myaadhaar aadhaarcard eaadhaar | uidaiaadhaar
IRCTC | irctc | government | irctc.co.in irctc.com indianrail.gov.in | irctc | irctctourism |
"""

# --- fixed values: domain | slug | reason ---
ALLOWED = """
sbicard.com | sbi | SBI Cards
sbilife.co.in | sbi | SBI Life Insurance
sbigeneral.in | sbi | SBI General Insurance
hdfclife.com | hdfc-bank | HDFC Life Insurance
hdfcsec.com | hdfc-bank | HDFC Securities
hdfcergo.com | hdfc-bank | HDFC ERGO General Insurance
icicidirect.com | icici-bank | ICICI Securities
icicilombard.com | icici-bank | ICICI Lombard General Insurance
iciciprulife.com | icici-bank | ICICI Prudential Life Insurance
axismf.com | axis-bank | Axis Mutual Fund
axisdirect.in | axis-bank | Axis Direct
kotaklife.com | kotak | Kotak Life Insurance
kotaksecurities.com | kotak | Kotak Securities
paytmmoney.com | paytm | Paytm Money
paytminsurance.co.in | paytm | Paytm Insurance
npciinternational.com | npci-upi | NPCI International Payments
bharatbillpay.com | npci-upi | Bharat BillPay
nsdl.co.in | income-tax | NSDL
utiitsl.com | income-tax | UTIITSL
irctctourism.com | irctc | IRCTC Tourism
irctcair.com | irctc | IRCTC Air
canarahsbclife.com | canara-bank | Canara HSBC Life Insurance
canararobeco.com | canara-bank | Canara Robeco Mutual Fund
airtel.com | airtel-payments-bank | Bharti Airtel
pnbhousing.com | pnb | PNB Housing Finance
pnbmetlife.com | pnb | PNB MetLife Insurance
"""


def cells(table: str) -> list[list[str]]:
    """The rows of a table of fixed values."""
    return [[c.strip() for c in line.split("|")] for line in table.strip().splitlines()]


def brands(spark: SparkSession) -> DataFrame:
    """The starting watchlist with ids and match terms, all active."""
    rows = [(i, name, slug, category, own.split(), aliases.split(), extra.split(), out.split(), True) for i, (name, slug, category, own, aliases, extra, out) in enumerate(cells(BRANDS))]
    return watchlist.with_terms(spark.createDataFrame(rows, watchlist.BRAND))


def allowlist(spark: SparkSession, brands_: DataFrame | None = None) -> DataFrame:
    """domain, brand_id (null for a slug that isn't in brands), reason, added_by."""
    rows = spark.createDataFrame([tuple(c) for c in cells(ALLOWED)], "domain string, slug string, reason string")
    known = (brands(spark) if brands_ is None else brands_).select("slug", F.col("id").alias("brand_id"))
    return rows.join(F.broadcast(known), "slug", "left").select("domain", "brand_id", "reason", F.lit("seed").alias("added_by"))
