"""Functions for the JVM, for loops that are sequential over bytes.

Their source is compiled on the driver, by the compiler that Spark itself carries for its generated code, into a jar that
Spark gives to every executor; nothing has to be installed. They take and return plain SQL values.
"""

from __future__ import annotations

import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql import types as T

PACKAGE = "ledgerlake.jvm"
_ready: dict[str, object] = {}

SOURCE = r"""
package ledgerlake.jvm;

import java.util.ArrayList;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.api.java.UDF1;
import org.apache.spark.sql.api.java.UDF2;

/** Runs of windows of WINDOW bytes with one minimizer: the least mixed hash of their GRAM-byte strings.
 *  A window's run has its minimizer as key, so equal windows have equal keys. */
class Runs {
  static final int WINDOW = 50, GRAM = 24, MOST = 64;
  static final long BASE = 0x9E3779B97F4A7C15L;

  static long mix(long x) {
    x = (x ^ (x >>> 30)) * 0xBF58476D1CE4E5B9L;
    x = (x ^ (x >>> 27)) * 0x94D049BB133111EBL;
    return x ^ (x >>> 31);
  }

  /** Fills key, first window and number of windows of each run; returns the number of runs. */
  static int find(byte[] b, ArrayList out) {
    int windows = b.length - WINDOW + 1, wide = WINDOW - GRAM + 1;
    if (windows <= 0) return 0;
    long top = 1;
    for (int i = 1; i < GRAM; i++) top *= BASE;
    long h = 0;
    for (int i = 0; i < GRAM - 1; i++) h = h * BASE + (b[i] & 255) + 1;
    int[] at = new int[wide + 1];      // a ring of grams with ascending hashes
    long[] value = new long[wide + 1];
    int head = 0, size = 0, ring = wide + 1;
    long key = 0;
    int from = -1, n = 0;
    for (int g = 0; g + GRAM <= b.length; g++) {
      h = h * BASE + (b[g + GRAM - 1] & 255) + 1;
      long v = mix(h);
      h -= top * ((b[g] & 255) + 1);
      while (size > 0 && value[(head + size - 1) % ring] > v) size--;
      at[(head + size) % ring] = g;
      value[(head + size) % ring] = v;
      size++;
      int w = g - wide + 1;            // the window whose last gram this is
      if (at[head] < w) { head = (head + 1) % ring; size--; }
      if (w < 0) continue;
      if (from >= 0 && value[head] == key && n < MOST) { n++; continue; }
      if (from >= 0) out.add(RowFactory.create(new Object[]{Long.valueOf(key), Integer.valueOf(from), Integer.valueOf(n)}));
      key = value[head]; from = w; n = 1;
    }
    out.add(RowFactory.create(new Object[]{Long.valueOf(key), Integer.valueOf(from), Integer.valueOf(n)}));
    return out.size();
  }
}

public class Anchors implements UDF1 {
  public Object call(Object text) {
    ArrayList out = new ArrayList();
    if (text != null) Runs.find((byte[]) text, out);
    return out.toArray();
  }
}

/** Linear suffix sorting by grouping. Groups of suffixes that share a Lyndon prefix are looked at from the greatest down. Each suffix of
 *  the group finds, by pointers that skip what is greater, the nearest suffix before it that is smaller; that one's prefix grows by the
 *  group's, once for each such suffix, so it moves up within its own group. What remains are the groups of the longest Lyndon
 *  prefixes, in order; one walk through them, from the least suffix on, then puts the members of every group in order. */
class Grouping {
  static int[] suffixes(int[] t, int alphabet) {
    int n = t.length;
    int[] sa = new int[n], place = new int[n], group = new int[n], size = new int[n + 1], up = new int[n];
    int[] start = new int[alphabet + 1];
    for (int i = 0; i < n; i++) start[t[i] + 1 > alphabet ? alphabet : t[i] + 1]++;
    for (int c = 1; c <= alphabet; c++) start[c] += start[c - 1];
    int[] fill = new int[alphabet + 1];
    for (int c = 0; c < alphabet; c++) fill[c] = start[c];
    for (int i = 0; i < n; i++) {
      int c = t[i];
      group[i] = start[c];
      size[start[c]]++;
      place[i] = fill[c];
      sa[fill[c]++] = i;
    }
    int[] count = new int[n], parents = new int[n], head = new int[n + 2], next = new int[n], moved = new int[n];
    boolean[] known = new boolean[n];
    for (int end = n - 1; end > 0; ) {
      int g = group[sa[end]];
      // the nearest suffix before each member that is not in a greater group
      for (int x = g; x <= end; x++) {
        int i = sa[x], p = i - 1;
        while (p >= 0 && group[p] > g) p = up[p];
        up[i] = p;
      }
      // through members of the same group, to one of a smaller group
      for (int x = g; x <= end; x++) {
        int i = sa[x], p = up[i];
        while (p >= 0 && group[p] == g && !known[p]) p = up[p];
        int to = p >= 0 && group[p] == g ? up[p] : p;
        int j = i;
        while (j >= 0 && group[j] == g && !known[j]) { int k = up[j]; up[j] = to; known[j] = true; j = k; }
      }
      int m = 0, most = 0;
      for (int x = g; x <= end; x++) {
        int p = up[sa[x]];
        if (p < 0) continue;
        if (count[p]++ == 0) parents[m++] = p;
        if (count[p] > most) most = count[p];
      }
      for (int l = 1; l <= most; l++) head[l] = -1;
      for (int x = 0; x < m; x++) {
        int p = parents[x], l = count[p];
        next[p] = head[l];
        head[l] = p;
        count[p] = 0;
      }
      for (int l = most; l >= 1; l--) {
        for (int p = head[l]; p >= 0; p = next[p]) {
          int of = group[p], to = of + --size[of], from = place[p], other = sa[to];
          sa[to] = p; place[p] = to;
          sa[from] = other; place[other] = from;
        }
        for (int p = head[l]; p >= 0; p = next[p]) moved[p] = group[p] + size[group[p]];
        for (int p = head[l]; p >= 0; p = next[p]) { group[p] = moved[p]; size[moved[p]]++; }
      }
      end = g - 1;
    }
    int[] out = new int[n];
    int[] at = place;
    for (int i = 0; i < n; i++) at[i] = i;  // where the next member of the group that begins here goes
    boolean[] placed = new boolean[n];
    out[0] = n - 1;
    placed[n - 1] = true;
    for (int x = 0; x < n; x++) {
      int j = out[x] - 1;
      while (j >= 0 && !placed[j]) {
        out[at[group[j]]++] = j;
        placed[j] = true;
        j = up[j];
      }
    }
    return out;
  }
}

public class SuffixArray implements UDF1 {
  public Object call(Object text) {
    byte[] b = (byte[]) text;
    int[] t = new int[b.length + 1];
    for (int i = 0; i < b.length; i++) t[i] = (b[i] & 255) + 1;
    int[] sa = Grouping.suffixes(t, 257);
    Object[] out = new Object[b.length];
    for (int i = 0; i < b.length; i++) out[i] = Integer.valueOf(sa[i + 1]);
    return out;
  }
}

/** (s, lo, hi, key) rows, each s once, with the least and the greatest doc that hold it: of those that lose anything the key, the string, lo, and the
 *  spans (from, to) of its windows that a smaller doc than lo holds. What holds s and is greater than lo loses all of it. */
public class Least implements UDF1 {
  public Object call(Object rows) {
    scala.collection.Seq seq = (scala.collection.Seq) rows;
    int m = seq.length(), n = 1;
    byte[][] s = new byte[m][];
    long[] doc = new long[m];
    boolean[] several = new boolean[m];
    for (int k = 0; k < m; k++) {
      Row r = (Row) seq.apply(k);
      s[k] = (byte[]) r.get(0);
      doc[k] = r.getLong(1);
      several[k] = r.getLong(2) > doc[k];
      n += s[k].length + 1;
    }
    int[] t = new int[n], of = new int[n], left = new int[n];
    int p = 0;
    for (int k = 0; k < m; k++) {
      for (int i = 0; i < s[k].length; i++) {
        t[p] = (s[k][i] & 255) + 2;
        of[p] = k;
        left[p++] = s[k].length - i;
      }
      t[p] = 1;
      of[p++] = k;
    }
    int[] sa = Grouping.suffixes(t, 258), rank = new int[n], lcp = new int[n];
    for (int i = 0; i < n; i++) rank[sa[i]] = i;
    int h = 0;
    for (int i = 0; i < n; i++) {
      if (rank[i] == 0) { h = 0; continue; }
      int j = sa[rank[i] - 1];
      while (i + h < n && j + h < n && t[i + h] == t[j + h]) h++;
      lcp[rank[i]] = h;
      if (h > 0) h--;
    }
    long[] least = new long[n];
    for (int x = 0; x < n; ) {
      int y = x + 1;
      long d = doc[of[sa[x]]];
      if (left[sa[x]] >= Runs.WINDOW) {
        while (y < n && lcp[y] >= Runs.WINDOW) { long e = doc[of[sa[y]]]; if (e < d) d = e; y++; }
        for (int z = x; z < y; z++) least[sa[z]] = d;
      }
      x = y;
    }
    ArrayList out = new ArrayList();
    p = 0;
    for (int k = 0; k < m; k++) {
      int w = Math.max(0, s[k].length - Runs.WINDOW + 1);
      ArrayList spans = null;
      for (int i = 0; i < w; i++) {
        if (least[p + i] >= doc[k]) continue;
        int from = i;
        while (i + 1 < w && least[p + i + 1] < doc[k]) i++;
        if (spans == null) spans = new ArrayList();
        spans.add(RowFactory.create(new Object[]{Integer.valueOf(from), Integer.valueOf(i + Runs.WINDOW)}));
      }
      if (spans != null || several[k]) out.add(RowFactory.create(new Object[]{((Row) seq.apply(k)).get(3), s[k], Long.valueOf(doc[k]), spans == null ? null : spans.toArray()}));
      p += s[k].length + 1;
    }
    return out.toArray();
  }
}

/** The strings of the given runs (key, first window, number of windows). */
public class Strings implements UDF2 {
  public Object call(Object text, Object runs) {
    byte[] b = (byte[]) text;
    scala.collection.Seq seq = (scala.collection.Seq) runs;
    Object[] out = new Object[seq.length()];
    for (int k = 0; k < out.length; k++) {
      Row r = (Row) seq.apply(k);
      int from = r.getInt(1), n = r.getInt(2);
      out[k] = RowFactory.create(new Object[]{Long.valueOf(r.getLong(0)), Integer.valueOf(from), java.util.Arrays.copyOfRange(b, from, from + n - 1 + Runs.WINDOW)});
    }
    return out;
  }
}

/** The text without the bytes in any of the spans (from, to): bytes before, bytes and spans removed, and what is left. */
public class Without implements UDF2 {
  public Object call(Object text, Object spans) {
    byte[] b = text == null ? new byte[0] : (byte[]) text;
    boolean[] gone = new boolean[b.length];
    if (spans != null) {
      scala.collection.Seq seq = (scala.collection.Seq) spans;
      int[] step = new int[b.length + 1];
      int m = seq.length();
      scala.collection.Iterator it = seq.iterator();
      while (it.hasNext()) { Row r = (Row) it.next(); step[r.getInt(0)]++; step[r.getInt(1)]--; }
      int open = 0;
      for (int i = 0; i < b.length; i++) { open += step[i]; gone[i] = open > 0; }
    }
    int n = 0;
    long runs = 0;
    ArrayList where = new ArrayList();
    byte[] kept = new byte[b.length];
    for (int i = 0; i < b.length; i++) {
      if (!gone[i]) { kept[n++] = b[i]; continue; }
      if (i == 0 || !gone[i - 1]) {
        int e = i;
        while (e < b.length && gone[e]) e++;
        where.add(RowFactory.create(new Object[]{Integer.valueOf(i), Integer.valueOf(e)}));
        runs++;
      }
    }
    return RowFactory.create(new Object[]{Long.valueOf(b.length), Long.valueOf(b.length - n), Long.valueOf(runs), java.util.Arrays.copyOf(kept, n), where.toArray()});
  }
}
"""

RUNS = "array<struct<key: bigint, first: int, n: int>>"
FUNCTIONS = {
    "ll_anchors": ("Anchors", RUNS),
    "ll_suffix_array": ("SuffixArray", "array<int>"),
    "ll_least": ("Least", "array<struct<key: bigint, s: binary, lo: bigint, lost: array<struct<begin: int, stop: int>>>>"),
    "ll_strings": ("Strings", "array<struct<key: bigint, first: int, s: binary>>"),
    "ll_without": ("Without", "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept: binary, spans: array<struct<begin: int, stop: int>>>"),
}


def register(spark: SparkSession) -> None:
    """The functions, for this session; compiled and sent once for each application."""
    jvm, sc = spark._jvm, spark.sparkContext
    thread = jvm.java.lang.Thread.currentThread()
    if sc.applicationId not in _ready:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(thread.getContextClassLoader())
        compiler.cook(SOURCE)
        made = compiler.getBytecodes()
        name = f"{tempfile.mkdtemp(prefix='ledgerlake-')}/functions.jar"  # stays: executors that come later fetch it
        with zipfile.ZipFile(name, "w") as z:
            for k in made:
                z.writestr(f"{k.replace('.', '/')}.class", bytes(made[k]))
        spark.sql(f"ADD JAR '{name}'")
        _ready[sc.applicationId] = thread.getContextClassLoader()
    loader, gateway = _ready[sc.applicationId], sc._gateway
    for name, (kind, returns) in FUNCTIONS.items():
        made = loader.loadClass(f"{PACKAGE}.{kind}").getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0)).newInstance(gateway.new_array(jvm.java.lang.Object, 0))
        spark._jsparkSession.udf().register(name, made, spark._jsparkSession.parseDataType(T._parse_datatype_string(returns).json()))
