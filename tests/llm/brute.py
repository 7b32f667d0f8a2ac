"""Slow, independent versions of the operators, in plain Python."""

import collections
import json

import duckdb

import re,sys,unicodedata
from datetime import datetime
from pathlib import Path
from zoneinfo import ZoneInfo
sys.path.insert(0,str(Path(__file__).resolve().parents[1]))
from brute_times import norm

def ident(v):
    if v is None: return ''
    s=unicodedata.normalize('NFKC',v); s=''.join(c for c in s if unicodedata.category(c) not in('Cf','Cc','Zs','Zl','Zp') and not c.isspace()).upper()
    return '' if s in('N/D','N/A','NULL','S/D','SIN_DATO','SIN_PLANTILLA') or re.fullmatch(r'[\W_]*',s) else s
def order(v):
    s=ident(v); m=re.fullmatch(r'PO[-‐-―−]*(\d{4})[-‐-―−]*(\d{6})',s); return f'PO-{m[1]}-{m[2]}' if m else None
def amt(v):
    from decimal import Decimal
    s=ident(v); s=re.sub(r'^(EUR|€)|(EUR|€)$','',s)
    if re.fullmatch(r'\d+',s): return Decimal(s)
    if re.fullmatch(r'\d+[.,](\d\d?|\d{4,})',s): return Decimal(s.replace(',','.'))
    if re.fullmatch(r'\d{1,3}(\.\d{3})+,\d+',s): return Decimal(s.replace('.','').replace(',','.'))
    if re.fullmatch(r'\d{1,3}(,\d{3})+\.\d+',s): return Decimal(s.replace(',',''))
    return None

def p1(sf):
    d=sf
    par={}
    def find(x):
        par.setdefault(x,x)
        while par[x]!=x: par[x]=par[par[x]]; x=par[x]
        return x
    sup=collections.defaultdict(set); files=set()
    for f,t,s,fi,e in duckdb.sql(f"select file_id,template_id,supplier_id,field,expected from '{d}/ocr_labels.parquet'").fetchall():
        files.add(f); find(('f',f))
        for k,v in (('s',ident(s)),('t',ident(t)),('n',ident(e) if fi=='supplier_nif' else '')):
            if v: par[find((k,v))]=find(('f',f))
        if ident(s): sup[f].add(ident(s))
    sp=collections.defaultdict(set)
    for t in('ocr_splits','ocr_report'):
        for f,s in duckdb.sql(f"select file_id,split from '{d}/{t}.parquet'").fetchall():
            s=ident(s).lower(); s='validation' if s=='val' else s
            if s: sp[f].add(s)
    g=collections.defaultdict(list)
    for f in files: g[find(('f',f))].append(f)
    out=set()
    for m in g.values():
        if len(set().union(*[sp[f] for f in m]))>1:
            n=set().union(*[sup[f] for f in m]); k=min(n) if n else None
            out|={(f,k) for f in m}
    return out
def fname(f):
    if f is None: return None
    s=unicodedata.normalize('NFKC',f).lower().strip()
    s=re.sub(r'\.pdf$','',s)
    while True:
        t=re.sub(r'^copia[ _]de[ _]|[ _]*\(\d+\)$|[ _-]+(copia|copy|v\d+)$','',s).strip(' _')
        if t==s: break
        s=t
    return re.sub(r'[\s_]','',s) or None
def p2(sf):
    d=sf
    acc=[];bysha={};byb=collections.defaultdict(set);byf=collections.defaultdict(set);sig={};out=set()
    for i,f,h,e,c in duckdb.sql(f"select id,file_id,sha256,extraction,created from '{d}/invoice_documents.parquet' order by created,id").fetchall():
        h=re.sub('^sha256:','',ident(h).lower())
        S=[None]*5
        if e:
            F=json.loads(e)['fields']; g=lambda k:(F.get(k) or {}).get('value')
            S=[unicodedata.normalize('NFC',ident(g('invoice_number'))) or None,ident(g('supplier_nif')) or None,order(g('order')) or ident(g('order')) or None,norm(g('date')) or ident(g('date')) or None,str(amt(g('total')) or '') or ident(g('total')) or None]
        hit=set()
        if h in bysha: hit.add(bysha[h])
        for k in range(5):
            o=tuple(S[j] for j in range(5) if j!=k)
            if None not in o: hit|=byb[(k,o)]
        if e is None: hit|=byf[fname(f)]
        if hit:
            for x in hit: out.add((min(x,i),max(x,i)))
        else:
            bysha[h]=i; byf[fname(f)].add(i)
            for k in range(5):
                o=tuple(S[j] for j in range(5) if j!=k)
                if None not in o: byb[(k,o)].add(i)
    return out

def ts(v):
    n=norm(v)
    if n is None: return None
    if len(n)==10:
        y,m,d=map(int,n.split('-')); return datetime(y,m,d,tzinfo=ZoneInfo('Europe/Madrid')).timestamp()
    return datetime.fromisoformat(n.replace('Z','+00:00')).timestamp()
def p5(d):
    comp=dict(duckdb.sql(f"select snapshot_id,complete from '{d}/erp_snapshot.parquet'").fetchall())
    g=collections.defaultdict(list)
    for r in duckdb.sql(f"select pedido,snapshot_id,idx,coalesce(fecha,fecha_registro),coalesce(importe,importe_esperado),coalesce(proveedor,proveedor_id),nif,estado from '{d}/erp_rows.parquet'").fetchall():
        o=order(r[0])
        if o: g[o].append(r)
    out=set()
    for o,rs in g.items():
        if len(rs)<2: continue
        for i,f in ((4,'importe'),(5,'proveedor'),(6,'nif'),(7,'estado')):
            c=[r for r in rs if (amt(r[i]) is not None if f=='importe' else ident(r[i]))]
            if c:
                b=max(c,key=lambda r:(bool(comp.get(r[1])),ts(r[3]) if ts(r[3]) is not None else -1e18,r[1],r[2])); out.add((o,f,b[1],b[2]))
    return out
def learned(rows):
    """depth of (field, value); rows: (order, time or None, snapshot, idx, {field: value or None})."""
    seen=collections.Counter()
    g=collections.defaultdict(list)
    for o,t,s,i,v in rows:
        if t is not None: g[o].append((t,s,i,v))
    for rs in g.values():
        rs.sort(key=lambda r:r[:3])
        for f in rs[0][3]:
            vs=[r[3][f] for r in rs if r[3][f] is not None]
            for a,b in zip(vs,vs[1:]):
                if a!=b: seen[f,a,b]+=1
    strong={(f,a,b):n for (f,a,b),n in seen.items() if n>=2 and n>seen.get((f,b,a),0)}
    came,went=collections.Counter(),collections.Counter()
    for (f,a,b),n in strong.items(): went[f,a]+=n; came[f,b]+=n
    late=lambda f,v:came[f,v]/(came[f,v]+went[f,v])
    out=collections.defaultdict(set)
    for f,a,b in strong: out[f,a].add((f,b))
    def reach(x):
        done,todo=set(),[x]
        while todo:
            for y in out[todo.pop()]:
                if y not in done: done.add(y); todo.append(y)
        return done
    to={x:reach(x) for x in list(out)}
    edges=[((f,a),(f,b)) for f,a,b in strong if late(f,a)<late(f,b) or (f,a) not in to.get((f,b),())]
    depth={x:0 for e in edges for x in e}
    moved=True
    while moved:
        moved=False
        for x,y in edges:
            if depth[y]<=depth[x]: depth[y]=depth[x]+1; moved=True
    return depth
def p5_rows(d):
    for r in duckdb.sql(f"select pedido,snapshot_id,idx,coalesce(fecha,fecha_registro),coalesce(importe,importe_esperado),coalesce(proveedor,proveedor_id),nif,estado from '{d}/erp_rows.parquet'").fetchall():
        o=order(r[0])
        if o: yield o,ts(r[3]),r[1],r[2],{'importe':amt(r[4]),'proveedor':ident(r[5]) or None,'nif':ident(r[6]) or None,'estado':ident(r[7]) or None}
def p5_current(d):
    comp=dict(duckdb.sql(f"select snapshot_id,complete from '{d}/erp_snapshot.parquet'").fetchall())
    rows=list(p5_rows(d)); depth=learned(rows)
    g=collections.defaultdict(list)
    for r in rows: g[r[0]].append(r)
    out=set()
    for o,rs in g.items():
        if len(rs)<2: continue
        for f in ('importe','proveedor','nif','estado'):
            c=[r for r in rs if r[4][f] is not None]
            dated=[r for r in c if r[1] is not None]; un=[r for r in c if r[1] is None]
            sure=lambda r:bool(comp.get(r[2])); dep=lambda r:depth.get((f,r[4][f]))
            a=max(dated,key=lambda r:(sure(r),r[1],r[2],r[3]),default=None)
            b=max(un,key=lambda r:(sure(r),-1 if dep(r) is None else dep(r),r[2],r[3]),default=None)
            if a and b:
                ka=(sure(a),10**9 if dep(a) is None else dep(a),1); kb=(sure(b),-1 if dep(b) is None else dep(b),0)
                w=a if ka>kb else b
            else: w=a or b
            if w: out.add((o,f,w[2],w[3]))
    return out
CONF=dict(zip("АВСЕНІКМОРЅТХаеосрхуіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧοУ","ABCEHIKMOPSTXaeocpxyijsABEZHIKMNOPTYXoY"))
def skel(s):
    out=[]
    for c in unicodedata.normalize('NFD',s):
        if unicodedata.category(c)=='Cf': continue
        if unicodedata.decomposition(c).startswith('<wide>'): c=unicodedata.normalize('NFKC',c)
        if unicodedata.category(c)=='Zs' or c=='\t': c=' '
        if unicodedata.category(c)=='Pd' or c=='−': c='-'
        out.append(CONF.get(c,c))
    return unicodedata.normalize('NFC',''.join(out))
def p6(d):
    out=set()
    for f,i,o,e in duckdb.sql(f"select file_id,field,observed,expected from '{d}/ocr_report.parquet'").fetchall():
        if o is not None and e is not None and o!=e and skel(o)==skel(e): out.add(('ocr_report',f,i))
    for i,e in duckdb.sql(f"select id,extraction from '{d}/invoice_documents.parquet' where extraction is not null").fetchall():
        for p in json.loads(e)['pages']:
            for l in p['lines']:
                a,b=l['raw_text'],l['text']
                if a is not None and b is not None and a!=b and skel(a)==skel(b): out.add(('invoice_documents',i,str(l['line_no'])))
    return out
def W(t):
    t=''.join(c for c in unicodedata.normalize('NFKD',t) if not unicodedata.combining(c) and unicodedata.category(c)!='Cf').lower()
    return re.findall(r'[^\W_]+',t)
def p7(d):
    idx=collections.defaultdict(set)
    for i,t in duckdb.sql(f"select item_id,text from '{d}/eval_items.parquet'").fetchall():
        w=W(t)
        for k in range(len(w)-11): idx[tuple(w[k:k+12])].add(i)
    out=set()
    for i,t in duckdb.sql(f"select doc_id,text from '{d}/documents.parquet' where text is not null").fetchall():
        w=W(t)
        for k in range(len(w)-11):
            for j in idx.get(tuple(w[k:k+12]),()): out.add((i,j))
    return out
