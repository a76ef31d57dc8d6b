"""Reading notices: one walk, only the parts asked for, nothing kept where one table is used."""

from lotlens.lineage import cut
from lotlens.plans import notices as pn
from lotlens.plans.base import Tables
from lotlens.sources import notices as nt

from .test_notices import EXT, call, lot

PATH = "/root/testdata/sf0.001"


def test_lift():
    ubo = "<efac:Organizations><efac:Organization><efac:UltimateBeneficialOwner><cbc:ID> u </cbc:ID></efac:UltimateBeneficialOwner></efac:Organization></efac:Organizations>"
    green = EXT.format("<efac:StrategicProcurement><efac:A><cbc:Code>x</cbc:Code><cbc:None> </cbc:None></efac:A></efac:StrategicProcurement>")
    part = "<cac:SubordinateAwardingCriterion><cbc:Name>p</cbc:Name>" + EXT.format("<efac:AwardCriterionParameter><efbc:ParameterNumeric>70</efbc:ParameterNumeric></efac:AwardCriterionParameter>") + "</cac:SubordinateAwardingCriterion>"
    terms = green + f"<cac:AwardingTerms><cac:AwardingCriterion>{part}<cbc:Description>a</cbc:Description><cbc:Description/><cbc:Description> b</cbc:Description></cac:AwardingCriterion></cac:AwardingTerms>"
    xml = call(lot("L", "<cbc:Name> </cbc:Name><cbc:Name>late</cbc:Name>", terms), ubo)
    n = nt.lift(xml)
    x = n["lots"][0]
    assert (n["kind"], n["notice_id"], n["buyer_org"], n["orgs"][0]["buyer_name"], n["orgs"][1]["ubos"]) == ("ContractNotice", "N1", "ORG-1", "Stadt X", ["u"])
    assert x["title"] is None and (x["lot_id"], x["scheme"], x["terms_description"]) == ("L", "Lot", ["a", "b"])  # the first name decides
    assert x["strategic_procurement"] == [{"code": "Code", "value": "x"}] and (x["award_criteria"][0]["name"], x["award_criteria"][0]["weight"]) == ("p", "70")
    assert "lots" not in nt.lift(xml, ("orgs",)) and nt.lift(xml, ("orgs",))["orgs"] == n["orgs"]


def test_nothing_is_kept_for_one_table(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(nt, "cut", lambda df: kept.append(df) or cut(df))
    once = nt.refine(pn.calls(Tables(spark, PATH)), keep=False)
    assert not kept
    all_ = nt.refine(pn.calls(Tables(spark, PATH)))
    assert len(kept) == 1
    for a, b in zip(once, all_, strict=True):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r.error.split(":")[0] for r in once[2].collect()} == {"ParseError"}


def test_no_xml_is_shuffled(spark):
    for files in (pn.calls, pn.prizes):
        plan = files(Tables(spark, PATH))._jdf.queryExecution().executedPlan().toString()
        assert "<cbc:ID>" not in plan[plan.rindex("Exchange") :]


def test_statistics_read_results_only(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(nt, "lifted", lambda files, parts=None, f=nt.lifted: asked.append(parts) or f(files, parts))
    rows = pn.bid_statistics(Tables(spark, PATH))
    assert asked == [("results",)] and rows.agg({"lots": "sum"}).first()[0] == Tables(spark, PATH).lineitem.count()
