"""A small document of our own that has every element."""

from ionframe.functions import codecs
from ionframe.functions import cv as V

F64, ZLIB, NONE = V.BINARY_DATA_TYPE["float_64"], V.COMPRESSION["zlib_compression"], V.COMPRESSION["no_compression"]


def param(accession, name="", value=None, unit=None):
    value = "" if value is None else f' value="{value}"'
    unit = "" if unit is None else f' unitName="{unit}"'
    return f'<cvParam cvRef="MS" accession="{accession}" name="{name}"{value}{unit}/>'


def array(values, term, compression=ZLIB, dtype=F64, text=None):
    text = codecs.encode(values, compression, dtype) if text is None else text
    kinds = "".join(param(a) for a in (compression, dtype) if a)
    return f'<binaryDataArray encodedLength="{len(text)}">{kinds}{param(term)}<binary>{text}</binary></binaryDataArray>'


def spectrum(k, body="", arrays="", ident=None, index=None):
    ident = f"scan={k}" if ident is None else ident
    return f'<spectrum id="{ident}" index="{k if index is None else index}" defaultArrayLength="3">{body}<binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>'


TIMES = (("millisecond", "1500"), ("second", "2.5"), ("Minute", "1"), ("hour", "0.5"), ("fortnight", "1"), (None, "7"))


def spectra(n=6):
    out = []
    for k in range(n):
        unit, value = TIMES[k % len(TIMES)]
        window = f'<scanWindowList count="{k % 3}">' + "".join(f"<scanWindow>{param('MS:1000501', '', 100 + j)}{param('MS:1000500', '', 900 + j)}</scanWindow>" for j in range(k % 3)) + "</scanWindowList>"
        scan = f'<scanList count="1">{param("MS:1000571")}<scan>{param("MS:1000016", "", value, unit)}{window}</scan></scanList>'
        more = ""
        if k % 2:
            ion = f"<selectedIon>{param('MS:1000744', '', 445.5)}{param('MS:1000041', '', 2)}</selectedIon>"
            more = f'<precursorList count="1"><precursor spectrumRef="scan={k - 1}"><isolationWindow>{param("MS:1000827", "", 445.25)}</isolationWindow><selectedIonList count="1">{ion}</selectedIonList><activation>{param("MS:1000133")}{param("MS:1000422")}{param("MS:1000045", "", 35)}</activation></precursor></precursorList>'
            more += f'<productList count="1"><product><isolationWindow>{param("MS:1000827", "", 99)}</isolationWindow></product></productList>'
        body = f'<referenceableParamGroupRef ref="g1"/>{param("MS:1000511", "ms level", k % 2 + 1)}{param("MS:1000127" if k % 2 else "MS:1000128")}{param("MS:1000285", "total ion current", 10.5 * k)}<userParam name="note" value=" v{k} " typeValue="t"/>{scan}{more}'
        out.append(spectrum(k, body, array([1.0 * k, 2, 3], "MS:1000514") + array([5, 6, 7.25], "MS:1000515")))
    return out


def chromatogram(ident, term):
    return f'<chromatogram id="{ident}" index="0" defaultArrayLength="2">{param(term)}<binaryDataArrayList count="2">{array([0, 1], "MS:1000595")}{array([9, 8], "MS:1000515")}</binaryDataArrayList></chromatogram>'


HEADER = f"""<cvList count="2"><cv id="MS" fullName="Mass" version="4.1" URI="u"/><cv id="UO" fullName="Unit"/></cvList>
<fileDescription><fileContent>{param("MS:1000579", "MS1 spectrum")}</fileContent>
<sourceFileList count="2"><sourceFile id="f1" name="a.raw" location="file://x">{param("MS:1000569", "SHA-1", "abc")}</sourceFile><sourceFile id="f2" name="b" location="y"/></sourceFileList>
<contact>{param("MS:1000586", "contact name", "Ada")}{param("MS:1000589", "email", "a@x")}</contact><contact/></fileDescription>
<referenceableParamGroupList count="1"><referenceableParamGroup id="g1">{param("MS:1000130", "positive scan")}</referenceableParamGroup></referenceableParamGroupList>
<sampleList count="2"><sample id="s1" name="One"/><sample id="s2" name=""/></sampleList>
<softwareList count="2"><software id="w1" version="1"/><software id="w1" version="2"/></softwareList>
<scanSettingsList count="1"><scanSettings id="ss"><sourceFileRefList count="1"><sourceFileRef ref="f1"/></sourceFileRefList><targetList count="1"><target>{param("MS:1000744", "", 1000)}</target></targetList></scanSettings></scanSettingsList>
<instrumentConfigurationList count="1"><instrumentConfiguration id="ic"><componentList count="3"><source order="1"/><analyzer order="2"/><detector order="x"/></componentList><softwareRef ref="w1"/></instrumentConfiguration></instrumentConfigurationList>
<dataProcessingList count="1"><dataProcessing id="dp"><processingMethod order="1" softwareRef="w1">{param("MS:1000544")}</processingMethod></dataProcessing></dataProcessingList>"""


def document(records=None, chromatograms=None, header=HEADER, index=True, encoding="utf-8", start="2019-11-03T08:41:07.00035+02:00"):
    records = spectra() if records is None else records
    chromatograms = [chromatogram("tic", "MS:1000235"), chromatogram("c&amp;2", "MS:1000627")] if chromatograms is None else chromatograms
    text = f'<?xml version="1.0" encoding="{encoding}"?>\n<indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML id="m" version="1.1.0">\n{header}\n<run id="r" defaultInstrumentConfigurationRef="ic" startTimeStamp="{start}"><spectrumList count="{len(records)}">\n'
    offsets = {"spectrum": [], "chromatogram": []}
    for kind, items in (("spectrum", records), ("chromatogram", chromatograms)):
        if kind == "chromatogram":
            text += f'</spectrumList><chromatogramList count="{len(items)}">\n'
        for item in items:
            offsets[kind].append((item.split('id="')[1].split('"')[0], len(text.encode(encoding))))
            text += item + "\n"
    text += "</chromatogramList></run></mzML>"
    if index:
        at = len(text.encode(encoding)) + 1
        lists = "".join(f'<index name="{k}">' + "".join(f'<offset idRef="{i}">{o}</offset>' for i, o in v) + "</index>" for k, v in offsets.items())
        text += f"\n<indexList count=\"2\">{lists}</indexList><indexListOffset>{at}</indexListOffset></indexedmzML>"
    return text
