"""SQL that writes the exports of the orders' layout texts: the same texts as bauwerk.sinks.export, put together from below."""

from __future__ import annotations

#: What the parser finds in the texts: final positions, nodes, documents and warnings. Needs the view items before it.
PARSED = """
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_rows, row_number() OVER (PARTITION BY doc_id, oz ORDER BY seq) AS nth FROM items),
pos AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY oz, seq) AS seq, seq AS old, oz, substr(oz, 1, 8) AS leaf_oz, quantity, unit_price, short_text, flag = 'R' AS only_price,
    CASE WHEN flag <> 'R' THEN CAST(round_even(quantity * unit_price, 2) AS DECIMAL(18,2)) END AS total_price,
    CASE WHEN seq >= 3 THEN 2 ELSE 1 END AS page_from, CASE WHEN seq >= 3 OR (seq = 2 AND n_rows > 2) THEN 2 ELSE 1 END AS page_to, nth, flag, total_price AS printed FROM counted
), levels AS (
  SELECT doc_id, substr(oz, 1, 2) AS oz, '' AS parent_oz, 1 AS level, seq FROM items
  UNION ALL SELECT doc_id, substr(oz, 1, 5), substr(oz, 1, 2), 2, seq FROM items
  UNION ALL SELECT doc_id, substr(oz, 1, 8), substr(oz, 1, 5), 3, seq FROM items
), firsts AS (SELECT doc_id, oz, parent_oz, level, min(seq) AS first FROM levels GROUP BY ALL), nodes AS (
  SELECT doc_id, oz, parent_oz, level, CASE oz WHEN '01' THEN 'Bereich eins' WHEN '01.01' THEN 'Titel neu' ELSE '' END AS title,
    CASE WHEN oz IN ('01', '01.01') OR first < 3 THEN 1 ELSE 2 END AS page FROM firsts
), docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'lv' || o_orderkey || '.pdf' AS source, 'Kunde ' || o_custkey AS client, 'Vorwort ' || o_orderpriority AS preamble
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
), walked AS (
  SELECT *, min(old) OVER (PARTITION BY doc_id, substr(oz, 1, 2)) AS first1, min(old) OVER (PARTITION BY doc_id, substr(oz, 1, 5)) AS first2, min(old) OVER (PARTITION BY doc_id, leaf_oz) AS first3 FROM pos
), told AS (
  SELECT doc_id, 1 AS stage, row_number() OVER (PARTITION BY doc_id ORDER BY first1, first2, first3, old) AS ordinal, 'Doppelte OZ: ' || oz AS message FROM walked WHERE nth > 1
  UNION ALL SELECT doc_id, 4, seq, 'Preis korrigiert: ' || oz || ' – GP ' || rtrim(rtrim(CAST(printed AS VARCHAR), '0'), '.') || ' wurde aus Menge × EP als '
    || rtrim(rtrim(CAST(total_price AS VARCHAR), '0'), '.') || ' neu berechnet' FROM pos
    WHERE flag <> 'R' AND abs(total_price - printed) > 0.02 AND abs(round_even(quantity * printed, 2) - unit_price) > 0.02
  UNION ALL SELECT doc_id, 5, seq, 'Eventualposition prüfen: ' || oz || ' – in der GB-Spalte wurde ein Gesamtpreis erkannt, aber keine Untertitelsumme gefunden'
    FROM pos p WHERE flag = 'R' AND EXISTS (SELECT 1 FROM pos o WHERE o.doc_id = p.doc_id AND o.oz = p.oz AND o.flag NOT IN ('R', 'A'))
)
"""


def _tree(item: str, node: str, sep: str = "") -> str:
    """body(doc_id, body): item of each position inside node of each level; node sees children and own, empty texts
    where there are none. ``item`` and ``node`` are SQL over nodes and positions with their ids."""
    levels = f"""
ids AS (
  SELECT doc_id, oz, kind, seq, row_number() OVER (PARTITION BY doc_id ORDER BY oz, kind, seq) + 1 AS id
  FROM (SELECT doc_id, oz, 0 AS kind, 0 AS seq FROM nodes UNION ALL SELECT doc_id, oz, 1, seq FROM pos)
), item AS (
  SELECT p.doc_id, p.leaf_oz, string_agg({item}, '{sep}' ORDER BY p.seq) AS own, count(*) AS n
  FROM pos p JOIN ids i ON p.doc_id = i.doc_id AND i.kind = 1 AND i.seq = p.seq GROUP BY p.doc_id, p.leaf_oz
), node AS (SELECT n.*, i.id FROM nodes n JOIN ids i ON n.doc_id = i.doc_id AND n.oz = i.oz AND i.kind = 0)"""
    below = "(SELECT NULL AS doc_id, NULL AS parent_oz, NULL AS children)"
    for level in (3, 2, 1):
        levels += f""", made{level} AS (
  SELECT n.doc_id, n.parent_oz, string_agg({node}, '{sep}' ORDER BY n.oz) AS children
  FROM (SELECT node.*, coalesce(c.children, '') AS children, coalesce(item.own, '') AS own FROM node
    LEFT JOIN {below} c ON node.doc_id = c.doc_id AND node.oz = c.parent_oz LEFT JOIN item ON node.doc_id = item.doc_id AND node.oz = item.leaf_oz WHERE level = {level}) n
  GROUP BY n.doc_id, n.parent_oz
)"""
        below = f"made{level}"
    return levels


_PLAIN = "rtrim(rtrim(CAST({} AS VARCHAR), '0'), '.')"


def exchange(items: str, phase: str, priced: bool) -> str:
    """Phase 83 or 84, with or without prices; images and conflicts don't matter here."""
    prices = f"""'<UP>' || {_PLAIN.format("p.unit_price")} || '</UP>' || coalesce('<IT>' || {_PLAIN.format("p.total_price")} || '</IT>', '') ||""" if priced else ""
    item = f"""format('<Item ID="id{{:08d}}" RNoPart="', i.id) || substr(p.oz, 10) || '">' || CASE WHEN p.only_price THEN '<Provis>WithoutTotal</Provis><LumpSumItem>Yes</LumpSumItem>' ELSE '' END
    || '<Qty>' || {_PLAIN.format("p.quantity")} || '</Qty><QU>qm</QU>' || {prices} '<Description><CompleteText><DetailTxt><Text><p><span>liefern und montieren</span></p></Text></DetailTxt><OutlineText><OutlTxt><TextOutlTxt><p><span>'
    || p.short_text || '</span></p></TextOutlTxt></OutlTxt></OutlineText></CompleteText></Description></Item>'"""
    node = """format('<BoQCtgy ID="id{:08d}" RNoPart="', n.id) || split_part(n.oz, '.', n.level) || '"><LblTx><p><span>' || n.title || '</span></p></LblTx><BoQBody>' || n.children
    || CASE WHEN n.own <> '' THEN '<Itemlist>' || n.own || '</Itemlist>' ELSE '' END || '</BoQBody></BoQCtgy>'"""
    levels = "".join(f"<BoQBkdn><Type>BoQLevel</Type><LblBoQBkdn>{x}</LblBoQBkdn><Length>2</Length><Num>Yes</Num></BoQBkdn>" for x in ("Bereich", "Titel", "Untertitel"))
    money = "<Cur>EUR</Cur><CurLbl>Euro</CurLbl>"
    return f"""
WITH {items}, {PARSED}, {_tree(item, node)}, whole AS (
  SELECT d.doc_id, '<?xml version="1.0" encoding="UTF-8"?><GAEB xmlns="http://www.gaeb.de/GAEB_DA_XML/DA{phase}/3.3"><GAEBInfo><Version>3.3</Version><VersDate>2021-05</VersDate><Date>2024-01-02</Date><Time>03:04:05</Time>'
    || '<ProgSystem>bauwerk</ProgSystem><ProgName>bauwerk</ProgName><Certific>not certified</Certific></GAEBInfo><PrjInfo><NamePrj>01</NamePrj><LblPrj>' || d.source || '</LblPrj>{money}</PrjInfo><Award><DP>{phase}</DP>'
    || '<AwardInfo>{money}</AwardInfo><AddText><OutlineAddText><span>Vorbemerkungen</span></OutlineAddText><DetailAddText><p><span>' || d.preamble || '</span></p></DetailAddText></AddText><BoQ ID="id00000001"><BoQInfo><Name>01</Name><LblBoQ>'
    || d.source || '</LblBoQ><OutlCompl>AllTxt</OutlCompl>{levels}<BoQBkdn><Type>Item</Type><Length>3</Length><Num>Yes</Num></BoQBkdn></BoQInfo><BoQBody>' || m.children || '</BoQBody></BoQ></Award></GAEB>' AS xml
  FROM docs d JOIN made1 m ON d.doc_id = m.doc_id
), counts AS (SELECT doc_id, sum(n)::BIGINT AS n_items FROM item GROUP BY doc_id)
SELECT w.doc_id, n_items, sha256(xml) AS digest FROM whole w JOIN counts c ON w.doc_id = c.doc_id
"""


def master(items: str) -> str:
    """The master XML."""
    item = """'<Position oz="' || p.oz || '" seiteVon="' || p.page_from || '" seiteBis="' || p.page_to || '" eventual="' || p.only_price || '" nurEinheitspreis="' || p.only_price || '"><Kurztext>' || p.short_text
    || '</Kurztext><Langtext>liefern und montieren</Langtext><Menge einheit="qm">' || p.quantity || '</Menge><Preise waehrung="EUR"><Einheitspreis>' || p.unit_price || '</Einheitspreis><Gesamtbetrag>'
    || coalesce(CAST(p.total_price AS VARCHAR), '') || '</Gesamtbetrag></Preise></Position>'"""
    name = "CASE n.level WHEN 1 THEN 'Bereich' WHEN 2 THEN 'Titel' ELSE 'Untertitel' END"
    node = f"""'<' || {name} || ' oz="' || n.oz || '" seite="' || n.page || '"><Bezeichnung>' || n.title || '</Bezeichnung>' || n.own || n.children || '</' || {name} || '>'"""
    return f"""
WITH {items}, {PARSED}, {_tree(item, node)}, warned AS (
  SELECT doc_id, string_agg('<Warnung>' || message || '</Warnung>', '' ORDER BY stage, ordinal, message) AS w FROM told GROUP BY doc_id
), whole AS (
  SELECT d.doc_id, '<?xml version="1.0" encoding="UTF-8"?><Leistungsverzeichnis version="0.1" currency="EUR"><Metadaten><Quelldatei>' || d.source || '</Quelldatei><Projekt></Projekt><Auftraggeber>' || d.client
    || '</Auftraggeber><Bieter>Wir</Bieter></Metadaten><Vorbemerkungen>' || d.preamble || '</Vorbemerkungen><Hierarchie>' || m.children || '</Hierarchie>' || coalesce('<Validierung>' || w || '</Validierung>', '') || '</Leistungsverzeichnis>' AS xml
  FROM docs d JOIN made1 m ON d.doc_id = m.doc_id LEFT JOIN warned ON d.doc_id = warned.doc_id
), counts AS (SELECT doc_id, sum(n)::BIGINT AS n_items FROM item GROUP BY doc_id)
SELECT w.doc_id, n_items, sha256(xml) AS digest FROM whole w JOIN counts c ON w.doc_id = c.doc_id
"""


def _object(fields: list[tuple[str, str]], indent: str) -> str:
    """SQL for a JSON object over lines, its fields ``indent`` deep (SQL for blanks); values are SQL for JSON."""
    parts = [f"""{indent} || '  "{k}" : ' || {v}""" for k, v in fields]
    return "'{' || chr(10) || " + " || ',' || chr(10) || ".join(parts) + f" || chr(10) || {indent} || '}}'"


def json(items: str) -> str:
    """The indented JSON. Objects in lists begin on the list's line, so only objects add to the indentation."""
    quoted = lambda x: f"coalesce('\"' || {x} || '\"', 'null')"
    item = _object(
        [("oz", quoted("p.oz")), ("quantity", quoted("p.quantity")), ("unit", "'\"qm\"'"), ("unit_price", quoted("p.unit_price")), ("total_price", quoted("p.total_price")), ("short_text", quoted("p.short_text")),
         ("long_text", "'\"liefern und montieren\"'"), ("page_from", "p.page_from"), ("page_to", "p.page_to"), ("provisional", "p.only_price"), ("price_only", "p.only_price")],
        "repeat(' ', 8)",
    )
    listed = lambda x: f"CASE WHEN {x} = '' THEN '[ ]' ELSE '[ ' || {x} || ' ]' END"
    node = _object([("oz", quoted("n.oz")), ("title", quoted("n.title")), ("level", "n.level"), ("page", "n.page"), ("children", listed("n.children")), ("positions", listed("n.own"))], "repeat('  ', n.level)")
    whole = _object(
        [("source", quoted("d.source")), ("project", "'\"\"'"), ("client", quoted("d.client")), ("bidder", "'\"Wir\"'"), ("currency", "'\"EUR\"'"), ("preamble", quoted("d.preamble")),
         ("roots", listed("m.children")), ("warnings", listed("coalesce(w, '')"))],
        "''",
    )
    return f"""
WITH {items}, {PARSED}, {_tree(item, node, ", ")}, warned AS (
  SELECT doc_id, string_agg('"' || message || '"', ', ' ORDER BY stage, ordinal, message) AS w FROM told GROUP BY doc_id
), whole AS (
  SELECT d.doc_id, {whole} AS body FROM docs d JOIN made1 m ON d.doc_id = m.doc_id LEFT JOIN warned ON d.doc_id = warned.doc_id
), counts AS (SELECT doc_id, sum(n)::BIGINT AS n_items FROM item GROUP BY doc_id)
SELECT w.doc_id, n_items, sha256(body) AS digest FROM whole w JOIN counts c ON w.doc_id = c.doc_id
"""
