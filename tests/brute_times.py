"""A slow, independent reader of dates and times, in plain Python."""

import re,unicodedata
from datetime import datetime,timedelta,timezone,date
from zoneinfo import ZoneInfo
MON={}
for i,ws in enumerate("""enero gener janeiro gennaio janvier januar january jan
febrero febrer fevereiro febbraio février februar february feb
marzo març março mars märz march mar
abril aprile avril april apr
mayo maig maio maggio mai may
junio juny junho giugno juin juni june jun
julio juliol julho luglio juillet juli july jul
agosto agost août august aug
septiembre setembre setembro settembre septembre september sep
octubre outubro ottobre octobre oktober october oct
noviembre novembre novembro november nov
diciembre desembre dezembro dicembre décembre dezember december dec""".split("\n")):
    for w in ws.split(): MON[w]=i+1
Z={"Z":0,"UTC":0,"GMT":0,"WET":0,"WEST":1,"CET":1,"CEST":2}
def norm(v):
    if v is None: return None
    s=unicodedata.normalize('NFKC',v).strip().lower()
    if re.fullmatch(r'\d{10}|\d{13}|\d{16}',s):
        us=int(s)*{10:10**6,13:1000,16:1}[len(s)]
        return fmt(datetime(1970,1,1)+timedelta(microseconds=us))
    t=None; zone=None
    try:
        if m:=re.fullmatch(r'(\d{4})(\d\d)(\d\d)(?:t?(\d\d)(\d\d)(\d\d)(z)?)?',s):
            y,mo,d=map(int,m.groups()[:3]); 
            if m[4]: t=(int(m[4]),int(m[5]),int(m[6]),0); zone=m[7]
        else:
            m=re.match(r'(\d{4})-(\d\d)-(\d\d)|(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d\d)(?!\d)|(?:[a-z]{3}, )?(\d{1,2})\.? (?:de |d’)?([^\W\d]+) (?:de )?(\d{4})|([^\W\d]+) (\d{1,2}), (\d{4})',s)
            if not m: return None
            g=m.groups()
            if g[0]: y,mo,d=int(g[0]),int(g[1]),int(g[2])
            elif g[3]: d,mo,y=int(g[3]),int(g[4]),int(g[5])+(2000 if len(g[5])==2 else 0)
            elif g[6]: d,mo,y=int(g[6]),MON[g[7]],int(g[8])
            else: mo,d,y=MON[g[9]],int(g[10]),int(g[11])
            rest=s[m.end():]
            if rest:
                k=re.fullmatch(r'(?:,? |t)(\d{1,2})[:.](\d\d)(?::(\d\d)(?:\.(\d{1,6}))?)?(?: ([ap])\.? ?m\.?(?![a-z]))?(.*)',rest)
                if not k: return None
                h=int(k[1])
                if k[5]: h=h%12+(12 if k[5]=='p' else 0)
                t=(h,int(k[2]),int(k[3] or 0),int((k[4] or '0').ljust(6,'0'))); zone=k[6].strip()
        date(y,mo,d)
        if t is None: return f'{y:04}-{mo:02}-{d:02}'
        l=datetime(y,mo,d,*t)
    except (ValueError,KeyError): return None
    if not zone: z=ZoneInfo('Europe/Madrid')
    elif zone.upper() in Z: z=timezone(timedelta(hours=Z[zone.upper()]))
    elif k2:=re.fullmatch(r'([+-])(\d\d):?(\d\d)?',zone): z=timezone((1 if k2[1]=='+' else -1)*timedelta(hours=int(k2[2]),minutes=int(k2[3] or 0)))
    else:
        zn=zone.strip('[]'); zn='/'.join('_'.join(w.capitalize() for w in p.split('_')) for p in zn.split('/')).replace('Sao_paulo','Sao_Paulo')
        z=ZoneInfo(zn)
    return fmt(l.replace(tzinfo=z).astimezone(timezone.utc).replace(tzinfo=None))
def fmt(d): return d.strftime('%Y-%m-%dT%H:%M:%S.')+f'{d.microsecond:06}Z'
