from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"

# Three exports in layouts that banks use: signed amounts, split debit and
# credit, and JSON with a wrapper.
CARD_CSV = """Transaction Date,Post Date,Description,Category,Type,Amount
05/02/2031,05/03/2031,STARBUCKS HARBOUR,Food,Sale,-4.20
05/03/2031,05/04/2031,AMAZON PARCEL,Goods,Sale,-31.05
05/04/2031,05/05/2031,SALARY MAY,Income,Payment,3100.00
05/06/2031,05/07/2031,LYFT TO THE STATION,Travel,Sale,-12.40
05/07/2031,05/08/2031,SAFEWAY BASKET,Groceries,Sale,-64.15
05/11/2031,05/12/2031,RENT FOR MAY,Home,Sale,-1400.00
05/13/2031,05/14/2031,SPOTIFY FAMILY,Fun,Sale,-17.99
"""

CHECKING_CSV = """Date,Description,Debit,Credit,Running Bal.
05/02/2031,"STARBUCKS, HARBOUR SIDE",4.20,,"$9,120.80"
05/03/2031,"AMZN PARCEL",31.05,,"$9,089.75"
05/04/2031,"DIRECT DEPOSIT MAY",,3100.00,"$12,189.75"
05/05/2031,"ATM CASH 700800900100",80.00,,"$12,109.75"
05/06/2031,"LYFT   *RIDE",12.40,,"$12,097.35"
"""

GENERIC_JSON = """{"transactions": [
  {"date": "2031-05-02", "amount": -4.20, "memo": "coffee at the harbour"},
  {"date": "2031-05-03", "amount": -31.05, "memo": "a parcel"},
  {"date": "2031-05-04", "amount": 3100.00, "memo": "salary for May"}
]}
"""


@pytest.fixture(scope="session")
def spark():
    from cashweave.session import local_session
    s = local_session(cores=4, shuffle_partitions=8, app_name="cashweave-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def samples():
    d = tempfile.mkdtemp(prefix="cashweave-samples-")
    paths = {}
    for name, body in (("card_may.csv", CARD_CSV), ("checking_may.csv", CHECKING_CSV),
                       ("app_may.json", GENERIC_JSON)):
        p = os.path.join(d, name)
        with open(p, "w", encoding="utf-8") as f:
            f.write(body)
        paths[name.split("_")[0]] = p
    return paths
