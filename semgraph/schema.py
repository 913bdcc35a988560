"""Kinds, well-known keys and column layouts of the graph tables."""

from __future__ import annotations

# The kinds and levels of the graph document format, in their order.
SYMBOL_KINDS = ("module", "file", "namespace", "type", "method", "field", "property", "parameter")
EDGE_KINDS = ("contains", "dependsOn", "implements", "inherits", "calls", "references", "overrides")
VISIBILITIES = ("public", "internal", "protected", "private")
EVIDENCE_KINDS = ("syntax", "semantic", "inferred")
CONFIDENCES = ("none", "bestEffort", "proven")
ROLE_KEYS = ("native.referenceKind", "native.kind", "native.callKind")
# Attributes that mark a test method, and those that a runtime calls by reflection.
TEST_ATTRIBUTES = ("Test", "TestCase", "TestCaseSource", "Theory", "UnityTest", "Fact", "Xunit.Fact", "Xunit.Theory")
ENTRYPOINT_ATTRIBUTES = (
    "ContextMenu", "ContextMenuItem", "CustomEditor", "CustomPropertyDrawer", "DidReloadScripts", "InitializeOnEnterPlayMode", "InitializeOnLoad",
    "InitializeOnLoadMethod", "MenuItem", "OnOpenAsset", "PostProcessBuild", "PostProcessScene", "PostProcessSceneAttribute", "PreserveAttribute",
    "PropertyDrawer", "RuntimeInitializeOnLoadMethod", "ScriptedImporter", "SettingsProvider", "SettingsProviderGroup", "Shortcut", "ShortcutAttribute",
    "BurstCompile", "MonoPInvokeCallback", "Test", "TestCase", "TestCaseSource", "TestFixture", "TestFixtureSource", "Theory", "SetUp", "TearDown",
    "OneTimeSetUp", "OneTimeTearDown", "UnityTest", "UnitySetUp", "UnityTearDown",
)
# Methods that the engine runtime calls by name, and the bases whose types receive them.
MESSAGES = (
    "Awake", "Start", "OnEnable", "OnDisable", "OnDestroy", "Reset", "OnValidate", "Update", "FixedUpdate", "LateUpdate",
    "OnApplicationFocus", "OnApplicationPause", "OnApplicationQuit", "OnGUI", "OnDrawGizmos", "OnDrawGizmosSelected", "OnRenderImage", "OnPostRender",
    "OnPreRender", "OnPreCull", "OnBecameVisible", "OnBecameInvisible", "OnWillRenderObject", "OnRenderObject", "OnCollisionEnter", "OnCollisionExit",
    "OnCollisionStay", "OnTriggerEnter", "OnTriggerExit", "OnTriggerStay", "OnControllerColliderHit", "OnCollisionEnter2D", "OnCollisionExit2D",
    "OnCollisionStay2D", "OnTriggerEnter2D", "OnTriggerExit2D", "OnTriggerStay2D", "OnAudioFilterRead", "OnMouseEnter", "OnMouseExit", "OnMouseDown",
    "OnMouseUp", "OnMouseUpAsButton", "OnMouseDrag", "OnMouseOver", "OnParticleCollision", "OnParticleSystemStopped", "OnParticleTrigger",
    "OnTransformChildrenChanged", "OnTransformParentChanged", "OnApplicationGetFocus", "OnDisconnectedFromServer", "OnConnectedToServer",
    "OnInspectorGUI", "OnSceneGUI",
)
MESSAGE_BASES = ("UnityEngine.MonoBehaviour", "UnityEngine.ScriptableObject", "UnityEditor.Editor", "UnityEditor.EditorWindow", "UnityEngine.StateMachineBehaviour")

CALL_SITE = "struct<file_path: string, line: int, col: int, end_line: int, end_col: int, containing_symbol_id: string>"
EVIDENCE = "struct<kind: string, adapter_name: string, source_span: string, confidence: string>"
SYMBOLS = "id string, name string, qualified_name string, kind string, file_path string, line int, parent_id string, visibility string, is_abstract boolean, is_static boolean, properties map<string,string>"
EDGES = f"source_id string, target_id string, kind string, role string, evidence {EVIDENCE}, properties map<string,string>, call_site {CALL_SITE}, profiles array<string>, ord bigint"
