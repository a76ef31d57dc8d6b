"""Notice XML: derived fields, pointers, faults and packages."""

import io
import tarfile

from pyspark.sql import functions as F

from lotlens.operators import features as ft
from lotlens.sources import files as files_source
from lotlens.sources import notices as nt

EXT = "<ext:UBLExtensions><ext:UBLExtension><ext:ExtensionContent><efext:EformsExtension>{}</efext:EformsExtension></ext:ExtensionContent></ext:UBLExtension></ext:UBLExtensions>"
NS = 'xmlns:cbc="b" xmlns:cac="a" xmlns:ext="e" xmlns:efext="f" xmlns:efac="g" xmlns:efbc="h"'


def org(i, name, size="small", ubos=0):
    owners = "<efac:UltimateBeneficialOwner><cbc:ID>u</cbc:ID></efac:UltimateBeneficialOwner>" * ubos
    company = f"<cac:PartyIdentification><cbc:ID>{i}</cbc:ID></cac:PartyIdentification><cac:PartyName><cbc:Name>{name}</cbc:Name></cac:PartyName><efbc:CompanySizeCode>{size}</efbc:CompanySizeCode>"
    return f"<efac:Organization>{owners}<efac:Company>{company}</efac:Company></efac:Organization>"


def call(lots, ext=""):
    orgs = f"<efac:Organizations>{org('ORG-1', ' Stadt X ')}</efac:Organizations><efac:Publication><efbc:NoticePublicationID>00123-2026</efbc:NoticePublicationID><efbc:PublicationDate>2026-01-05+01:00</efbc:PublicationDate></efac:Publication>"
    return f"""<ContractNotice xmlns="n" {NS}>{EXT.format(orgs + ext)}<cbc:ID>N1</cbc:ID><cbc:ContractFolderID>P1</cbc:ContractFolderID><cbc:IssueDate>2026-01-02Z</cbc:IssueDate>
    <cac:ContractingParty><cac:Party><cac:PartyIdentification><cbc:ID>ORG-1</cbc:ID></cac:PartyIdentification></cac:Party></cac:ContractingParty>
    <cac:TenderingProcess><cac:TenderSubmissionDeadlinePeriod><cbc:EndDate>2026-02-01</cbc:EndDate></cac:TenderSubmissionDeadlinePeriod></cac:TenderingProcess>
    <cac:ProcurementProject><cac:MainCommodityClassification><cbc:ItemClassificationCode>45000000</cbc:ItemClassificationCode></cac:MainCommodityClassification></cac:ProcurementProject>{lots}</ContractNotice>""".encode()


def lot(i, project="", terms="", process="", scheme="Lot"):
    return f'<cac:ProcurementProjectLot><cbc:ID schemeName="{scheme}">{i}</cbc:ID><cac:TenderingTerms>{terms}</cac:TenderingTerms><cac:TenderingProcess>{process}</cac:TenderingProcess><cac:ProcurementProject>{project}</cac:ProcurementProject></cac:ProcurementProjectLot>'


def refine(spark, *contents):
    files = spark.createDataFrame([(f"{k}.xml", bytearray(c)) for k, c in enumerate(contents)], "source_file string, content binary")
    return nt.refine(files)


def test_call(spark):
    a = lot(
        "LOT-1",
        '<cbc:Name> Dach </cbc:Name><cac:PlannedPeriod><cbc:DurationMeasure unitCode="month">2.7</cbc:DurationMeasure></cac:PlannedPeriod><cac:RequestedTenderTotal><cbc:EstimatedOverallContractAmount currencyID="EUR">-1</cbc:EstimatedOverallContractAmount></cac:RequestedTenderTotal><cac:ProcurementAdditionalType><cbc:ProcurementTypeCode>works</cbc:ProcurementTypeCode></cac:ProcurementAdditionalType>',
        "<cac:CallForTendersDocumentReference><cbc:DocumentType>restricted-document</cbc:DocumentType><cac:Attachment><cac:ExternalReference><cbc:URI>u1</cbc:URI></cac:ExternalReference></cac:Attachment></cac:CallForTendersDocumentReference>"
        "<cac:CallForTendersDocumentReference><cac:Attachment><cac:ExternalReference><cbc:URI>u2</cbc:URI></cac:ExternalReference></cac:Attachment></cac:CallForTendersDocumentReference>"
        "<cac:AwardingTerms><cac:AwardingCriterion><cbc:Description>Der  Preis ist nicht das einzige Zuschlagskriterium</cbc:Description></cac:AwardingCriterion></cac:AwardingTerms>"
        + EXT.format("<efac:SelectionCriteria><cbc:TendererRequirementTypeCode>slc-abil-x</cbc:TendererRequirementTypeCode></efac:SelectionCriteria>"),
        "<cac:OpenTenderEvent><cbc:OccurrenceDate>2026-01-20</cbc:OccurrenceDate></cac:OpenTenderEvent>",
    )
    b = lot("LOT-2", '<cac:PlannedPeriod><cbc:StartDate>2026-03-01</cbc:StartDate><cbc:EndDate>2026-03-10</cbc:EndDate></cac:PlannedPeriod><cac:MainCommodityClassification><cbc:ItemClassificationCode>45261000</cbc:ItemClassificationCode></cac:MainCommodityClassification>')
    tenders, awards, failures = refine(spark, call(a + b + lot("PAR-1", scheme="Part")), b"<broken", b"<Other/>")
    r = {x.lot_id: x for x in tenders.collect()}
    one, two = r["LOT-1"], r["LOT-2"]
    assert set(r) == {"LOT-1", "LOT-2"} and awards.count() == 0
    assert (one.title, one.duration_days, one.duration_source, one.est_value_lot, one.est_value_lot_currency) == ("Dach", 60, "measure", None, "EUR")
    assert (one.cpv_main, two.cpv_main, one.n_lots, one.buyer_name, str(one.publication_date), str(one.issue_date)) == ("45000000", "45261000", 2, "Stadt X", "2026-01-05", "2026-01-02")
    assert (one.docs_restricted, one.docs_url, one.n_doc_references, two.docs_restricted) == (True, "u2", 2, None)
    assert (one.award_criterion_kind, one.n_criteria_technical, one.n_criteria_other, two.n_selection_criteria, one.is_strategic) == ("meat", 1, 0, None, False)
    assert one.quality_flags == ["criterion_kind_from_text", "opening_before_deadline"]
    assert (two.duration_days, two.duration_source, two.deadline_days) == (10, "dates", 30)
    assert [x.source_file for x in failures.collect()] == ["1.xml"]
    assert len(tenders.columns) == 104 and ft.roles_of(nt.tender_roles(tenders).filter("lot_id = 'LOT-1'"))["cpv_main"] == "hierarchical"
    assert nt.scoped(tenders, ["4526"], [], "2026-01-01", None).count() == 1


def test_award(spark):
    bids = "".join(
        f'<efac:LotTender><cbc:ID>T{k}</cbc:ID><cbc:RankCode>{rank}</cbc:RankCode><cac:LegalMonetaryTotal><cbc:PayableAmount currencyID="EUR">{amount}</cbc:PayableAmount></cac:LegalMonetaryTotal><efac:TenderingParty><cbc:ID>TP{k}</cbc:ID></efac:TenderingParty></efac:LotTender>'
        for k, rank, amount in ((1, 1, 100), (2, 2, 900))
    )
    parties = "".join(f"<efac:TenderingParty><cbc:ID>TP{k}</cbc:ID><efac:Tenderer><cbc:ID>ORG-{k}</cbc:ID></efac:Tenderer></efac:TenderingParty>" for k in (1, 2))
    result = """<efac:LotResult><cbc:ID>R1</cbc:ID><cbc:TenderResultCode>selec-w</cbc:TenderResultCode><efac:TenderLot><cbc:ID>LOT-1</cbc:ID></efac:TenderLot><efac:LotTender><cbc:ID>T1</cbc:ID></efac:LotTender><efac:LotTender><cbc:ID>T2</cbc:ID></efac:LotTender>
    <cbc:LowerTenderAmount>50</cbc:LowerTenderAmount><cbc:HigherTenderAmount>500</cbc:HigherTenderAmount><efac:ReceivedSubmissionsStatistics><efbc:StatisticsCode>tenders</efbc:StatisticsCode><efbc:StatisticsNumeric>0</efbc:StatisticsNumeric></efac:ReceivedSubmissionsStatistics></efac:LotResult>"""
    ext = f"<efac:NoticeResult>{result}{bids}{parties}</efac:NoticeResult><efac:Organizations>{org('ORG-1', 'A GmbH', 'micro', 2)}{org('ORG-2', 'B AG')}</efac:Organizations>"
    xml = f'<ContractAwardNotice xmlns="n" {NS}>{EXT.format(ext)}<cbc:ID>N2</cbc:ID><cbc:ContractFolderID>P1</cbc:ContractFolderID></ContractAwardNotice>'.encode()
    _, awards, _ = refine(spark, xml)
    r = awards.collect()[0]
    assert (r.lot_id, r.winner_names, r.winner_size, r.n_winning_bids, r.n_tenders, r.n_beneficial_owners) == ("LOT-1", ["A GmbH"], "micro", 2, 0, 2)
    assert r.quality_flags == ["selected_but_zero_tenders", "winner_but_zero_tenders", "winning_bid_outside_band"]
    assert r.winning_bids[1].amount == 900 and r.winning_bids[0].tenderer_names == ["A GmbH"] and len(awards.columns) == 45 + 1


def test_packages(spark, tmp_path):
    def tar(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, data in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    (tmp_path / "month.tar.gz").write_bytes(tar({"day.tar.gz": tar({"a/1.xml": b"<x/>"}), "2.xml": b"<y/>"}))
    assert sorted(r.source_file for r in nt.read_packages(spark, str(tmp_path)).collect()) == ["1.xml", "2.xml"]


def test_acquisition_and_statistics(spark):
    want = {"kinds": ["cn-standard"], "cpvs": ["45", "71000000"], "country": "DEU", "date_from": "2026-01-01", "date_to": "2026-01-31"}
    rows = [
        (1, "cn-standard", ["45261000"], "DEU", "2026-01-05", "1-2026"), (2, "pin", ["45261000"], "DEU", "2026-01-05", "1-2026"), (3, "cn-standard", ["71000001"], "DEU", "2026-01-05", "1-2026"),
        (4, "cn-standard", ["71000000"], "FRA", "2026-01-05", "1-2026"), (5, "cn-standard", ["71000000"], "DEU", "2026-02-01", "1-2026"), (6, "cn-standard", ["71000000"], "DEU", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, kind string, codes array<string>, country string, day string, number string")
    reason = nt.reject_reason(F.col("kind"), F.col("codes"), F.col("country"), F.col("day").cast("date"), F.col("number"), want)
    got = {r.id: r.why for r in df.select("id", reason.alias("why")).collect()}
    assert got == {1: None, 2: "notice-type", 3: "cpv", 4: "country", 5: "date", 6: "no-publication-id"}
    stat = "<efac:ReceivedSubmissionsStatistics><efbc:StatisticsCode>{}</efbc:StatisticsCode><efbc:StatisticsNumeric>{}</efbc:StatisticsNumeric></efac:ReceivedSubmissionsStatistics>"
    lots = "".join(f"<efac:LotResult><efac:TenderLot><cbc:ID>L{k}</cbc:ID></efac:TenderLot>{s}</efac:LotResult>" for k, s in enumerate((stat.format("t-sme", "") + stat.format("tenders", 4) + stat.format("t-esubm", 3), stat.format("tenders", -1) + stat.format("t-esubm", 2), "")))
    xml = f'<ContractAwardNotice xmlns="n" {NS}>{EXT.format(f"<efac:NoticeResult>{lots}</efac:NoticeResult>")}</ContractAwardNotice>'.encode()
    files = spark.createDataFrame([("a.xml", bytearray(xml))], "source_file string, content binary")
    notices = files.select("source_file", nt._lifted("content").alias("l")).select("source_file", F.from_json("l.raw", nt.RAW).alias("n"))
    assert {(r.lot_id, r.n_bids, r.n_bids_source) for r in nt.bid_statistics(notices).collect()} == {("L0", 4, "tenders"), ("L1", 2, "t-esubm"), ("L2", None, None)}


def test_range_split():
    held = {1: 3, 2: 5, 3: 0, 4: 9, 5: 1}
    count = lambda a, z: sum(held[k] for k in range(a, z + 1))
    parts = files_source.split_ranges(18, count, 1, 5, 8)
    assert parts[0][0] == 1 and parts[-1][1] == 5 and all(count(a, z) <= 8 or a == z for a, z in parts) and sum(count(a, z) for a, z in parts) == 18
